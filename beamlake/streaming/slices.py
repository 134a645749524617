"""Slice counts with a watermark, and beams row by row, over streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.operators.views import beams


def slice_counts(messages: DataFrame, slice_: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """(topic, start, messages) of messages(topic, ts): tumbling slices, closed once the watermark has passed them."""
    counted = messages.withWatermark("ts", late).groupBy(F.window("ts", slice_), "topic").agg(F.count("*").alias("messages"))
    return counted.select("topic", F.col("window.start").alias("start"), "messages")


def streamed_beams(points: DataFrame, uncertainty: float = 1.0) -> DataFrame:
    """Beams need nothing but their own row, so they work on a stream as they are."""
    return beams(points, uncertainty)
