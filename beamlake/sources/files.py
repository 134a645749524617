"""Results as files. Spark writes them, so any store will do; an output folder is replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.functions.text import clean_name


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Semicolons and a header; one_file for small lists."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small document as a folder with one part file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def export_clouds(points: DataFrame, names: DataFrame, path: str, file_format: str = "parquet") -> DataFrame:
    """Writes points(point_cloud_id, id, ...) below path/campaign=/mission=/sensor=/recording=/cloud=, names made safe, each cloud in the
    order of its ids. names: (point_cloud_id, campaign_name, mission_name, sensor_name, recording_name, point_cloud_name). Attributes that no
    point has are left out. Returns the written columns."""
    levels = ["campaign", "mission", "sensor", "recording", "cloud"]
    safe = names.select("point_cloud_id", *[clean_name(F.coalesce(F.col(f"{c if c != 'cloud' else 'point_cloud'}_name"), F.lit("unnamed"))).alias(c) for c in levels])
    has = points.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in points.columns if c != "point_cloud_id"]).first()
    columns = [c for c in points.columns if c != "point_cloud_id" and has[c]]
    out = points.select("point_cloud_id", *columns).join(safe, "point_cloud_id").select(*levels, *columns)
    ordered = out.repartitionByRange(*levels, "id").sortWithinPartitions(*levels, "id")
    if file_format == "xyz":
        ordered = ordered.select(*levels, F.concat_ws(" ", "position.x", "position.y", "position.z").alias("value"))
        ordered.write.mode("overwrite").partitionBy(*levels).text(path)
    else:
        ordered.write.mode("overwrite").partitionBy(*levels).parquet(path)
    return ordered


def cloud_names(clouds: DataFrame, recordings: DataFrame, sensors: DataFrame, missions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(point_cloud_id, names of campaign, mission, sensor, recording and cloud), in the order of export (null names last)."""
    named = lambda df, what, *more: df.select(F.col("id").alias(f"{what}_id"), F.col("name").alias(f"{what}_name"), *more)
    out = named(clouds, "point_cloud", "recording_id").join(named(recordings, "recording", "mission_id", "sensor_id"), "recording_id").join(named(sensors, "sensor"), "sensor_id")
    out = out.join(named(missions, "mission", "campaign_id"), "mission_id").join(named(campaigns, "campaign"), "campaign_id")
    order = [F.col(f"{c}_name").asc_nulls_last() for c in ("campaign", "mission", "recording", "point_cloud")]
    return out.select("point_cloud_id", "campaign_name", "mission_name", "sensor_name", "recording_name", "point_cloud_name").orderBy(*order)
