"""Recorded messages (Parquet: topic, ts_ns, chunk_id, message_id, frame, points) and the transforms between frames.

A message is a row; its points are an array of structs. Filters by topic and time reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.functions.text import rfc3339
from beamlake.functions.vector import add, rotate
from beamlake.operators.asof import interpolated, neighbours
from beamlake.schema import POINT, QUATERNION

MESSAGE = f"topic string, ts_ns long, chunk_id long, message_id int, frame string, points array<struct<position:{POINT},ts_ns:long,intensity:float>>"
TRANSFORM = f"path string, ts_ns long, position {POINT}, orientation {QUATERNION}"


def scan_messages(spark: SparkSession, path: str, topics: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    df = spark.read.schema(MESSAGE).parquet(path)
    df = df if topics is None else df.where(F.col("topic").isin(*topics))
    df = df if start_ns is None else df.where(F.col("ts_ns") >= start_ns)
    return df if end_ns is None else df.where(F.col("ts_ns") <= end_ns)


def clamped_span(first: int, last: int, start: int | None = None, offset: int = 0, end: int | None = None, duration: int | None = None) -> tuple[int, int, list[str]]:
    """(start, end, warnings): start (the recording's if not given) plus offset; an end wins over a duration; both held within the recording."""
    warnings = []
    begin = (first if start is None else start) + offset
    stop = end if end is not None else begin + duration if duration is not None else last
    if not first <= begin <= last:
        warnings.append("start is outside the recording")
        begin = min(max(begin, first), last)
    if not begin <= stop <= last:
        warnings.append("end is outside the recording")
        stop = min(max(stop, begin), last)
    return begin, stop, warnings


def slice_count(start_ns: int, end_ns: int, slice_ns: int) -> int:
    return max(1, -(-(end_ns - start_ns) // slice_ns))


def slice_index(ts_ns: Column, start_ns, end_ns, slice_ns: int) -> Column:
    """Slice of each time: [start + i s, start + (i + 1) s), the last one closed by the end; null outside."""
    start, end = (v if isinstance(v, Column) else F.lit(v) for v in (start_ns, end_ns))
    n = F.greatest(F.lit(1), F.ceil((end - start) / F.lit(slice_ns)))
    i = F.floor((ts_ns - start) / F.lit(slice_ns))
    return F.when((ts_ns >= start) & (ts_ns <= end), F.least(i, n - 1))


def sliced_points(messages: DataFrame, start_ns: int, end_ns: int, slice_ns: int = 5 * 10**9) -> DataFrame:
    """Points of the messages with topic, slice, cloud name ('<start>-<end>' of the slice), and where each came from. One point cloud for
    each topic and slice; a point without a time has its message's."""
    at = messages.withColumn("slice", slice_index(F.col("ts_ns"), start_ns, end_ns, slice_ns)).where("slice is not null")
    begin = F.lit(start_ns) + F.col("slice") * F.lit(slice_ns)
    name = F.concat(rfc3339(begin), F.lit("-"), rfc3339(F.least(begin + F.lit(slice_ns), F.lit(end_ns))))
    rows = at.select("topic", "slice", name.alias("name"), "frame", F.col("ts_ns").alias("message_ns"), F.col("chunk_id").alias("mcap_chunk_id"), F.col("message_id").alias("mcap_message_id"), F.posexplode("points").alias("pos", "p"))
    return rows.select("topic", "slice", "name", "frame", "mcap_chunk_id", "mcap_message_id", "message_ns", "pos", "p.position", F.coalesce("p.ts_ns", "message_ns").alias("ts_ns"), "p.intensity")


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """Transforms of JSON lines: path ('<parent>/<child>'), ts_ns, position, orientation."""
    return spark.read.schema(TRANSFORM).json(path)


def trajectory_kinds(transforms: DataFrame) -> DataFrame:
    """(path, samples, domain, interpolation_type, extrapolation_type): one sample is a static pose, more are a timed line."""
    n = transforms.groupBy("path").agg(F.count("*").alias("samples"))
    timed = F.col("samples") > 1
    return n.select("path", "samples", F.when(timed, "timed").otherwise("sequence").alias("domain"), F.when(timed, "linear").otherwise("step").alias("interpolation_type"), F.lit("constant").alias("extrapolation_type"))


def as_poses(transforms: DataFrame, kinds: DataFrame) -> DataFrame:
    """Poses of trajectories: a static one has sequence index 0 and no time, timed ones their time and no index."""
    timed = F.col("domain") == "timed"
    return transforms.join(kinds.select("path", "domain"), "path").select("path", F.when(timed, F.col("ts_ns")).alias("ts_ns"), F.when(~timed, F.lit(0)).cast("int").alias("sequence_index"), "position", "orientation")


def in_global_frame(points: DataFrame, transforms: DataFrame, frame: str = "frame", time: str = "ts_ns") -> DataFrame:
    """points with position (and sensor_position, where the frame's origin then is) in the parent frame of their frame's transform, taken
    at the point's time; points of a frame without transforms stay as they are."""
    near = neighbours(transforms.select(F.col("path").alias(frame), "ts_ns", "position", "orientation").withColumnRenamed("ts_ns", time), points.withColumnRenamed("position", "_local"), frame, time, ["position", "orientation"])
    moved, turned = interpolated(time)
    known = near.withColumns({"_at": moved, "_turn": turned})
    out = F.when(F.col("_at").isNotNull(), add(F.when(F.col("_turn").isNotNull(), rotate(F.col("_local"), F.col("_turn"))).otherwise(F.col("_local")), F.col("_at"))).otherwise(F.col("_local"))
    keep = [c for c in points.columns if c not in ("position", "sensor_position")]
    return known.select(*keep, out.alias("position"), F.col("_at").alias("sensor_position"))
