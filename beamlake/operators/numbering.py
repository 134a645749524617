"""Row numbers over a whole table without one task for all: sorted ranges are written once, counted, and each row adds its place in its
range to what lies before. Ranges come from samples, so the table is never ranged twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table below spark.checkpoint.dir, which all executors see; a local folder only for local masters."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='beamlake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with 1, 2, 3, ... in the order of the columns (nulls last); ties in any order. The table of ranges has a row for each partition."""
    by = [F.col(c).asc_nulls_last() for c in order]
    local = materialised(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_at", "_before")


def numbered_within(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """0, 1, 2, ... within each value of `by`; a large one is numbered by many tasks."""
    all_ = ranked(df, [by, *order], "_rank")
    first = all_.groupBy(by).agg(F.min("_rank").alias("_first"))
    return all_.join(first, by).withColumn(name, F.col("_rank") - F.col("_first")).drop("_rank", "_first")
