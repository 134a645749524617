"""Half-open bins by literal chains, the signature aggregates, their export and their names as properties."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamlake.operators.numbering import ranked

RANGE_BOUNDS = (0, 15, 30, 50, 100, 200, 500, 1000)
ZENITH_BOUNDS = tuple(math.radians(x) for x in (0, 20, 40, 60, 90))
AZIMUTH_BOUNDS = tuple(math.radians(x) for x in (0, 360))
PERCENTILES = (5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95)
#: Metrics that become properties, the last a count.
METRICS = ("intensity_min", "intensity_max", "intensity_mean", "intensity_stddev", "intensity_p25", "intensity_median", "intensity_p75", "points_count")
#: What property names begin with.
PREFIX = "lidar_"


def bin_index(value: Column, bounds) -> Column:
    """i (from 1) for bounds[i-1] <= value < bounds[i]; null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
        inside = (value >= float(lo)) & (value < float(hi))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def bin_bound(index: Column, bounds, upper: bool) -> Column:
    return F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), index + int(upper))


def percentile_name(p: int) -> str:
    return "intensity_median" if p == 50 else f"intensity_p{p}"


GROUP = ("feature_id", "sensor_id", "campaign_id", "range_bin", "zenith_bin", "azimuth_bin")


def signature_stats(beams: DataFrame, range_bounds=RANGE_BOUNDS, zenith_bounds=ZENITH_BOUNDS, azimuth_bounds=AZIMUTH_BOUNDS) -> DataFrame:
    """Intensity statistics by feature, sensor, campaign and the three bins, over all features at once.

    Exact percentiles (linear between neighbours) without holding a group: intensities are counted, a running count over each group's
    values says where each rank falls, and the values at the ranks are minima. All of it spills and is partial where it can be."""
    keyed = beams.where("feature_id is not null").select(
        "feature_id", "sensor_id", "campaign_id", "intensity",
        bin_index(F.col("spherical_range"), range_bounds).alias("range_bin"),
        bin_index(F.col("surface_zenith_angle"), zenith_bounds).alias("zenith_bin"),
        bin_index(F.col("surface_azimuth_angle"), azimuth_bounds).alias("azimuth_bin"),
    )
    counts = keyed.groupBy(*GROUP, "intensity").agg(F.count("intensity").alias("n"))
    group = Window.partitionBy(*GROUP)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col("intensity").cast("double")
    ranked = counts.withColumns({
        "upto": F.sum("n").over(group.orderBy("intensity").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(whole),
        "mean": F.sum(v * F.col("n")).over(whole),
    }).withColumn("mean", F.try_divide(F.col("mean"), F.col("total")))
    rank = lambda p: F.lit(p / 100) * (F.col("total") - 1)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.when(F.col("n") > 0, v)))
    marks = [m for p in PERCENTILES for m in (at(F.floor(rank(p))).alias(f"lo{p}"), at(F.ceil(rank(p))).alias(f"hi{p}"))]
    out = ranked.groupBy(*GROUP).agg(F.min("intensity").alias("intensity_min"), F.max("intensity").alias("intensity_max"), F.max("mean").alias("intensity_mean"), F.sum(F.col("n") * F.pow(v - F.col("mean"), 2)).alias("squares"), F.max("total").alias("total"), *marks)
    stddev = F.when(F.col("total") > 1, F.sqrt(F.try_divide(F.col("squares"), F.col("total") - 1)))
    part = lambda p: rank(p) - F.floor(rank(p))
    of = [(F.col(f"lo{p}") + (F.col(f"hi{p}") - F.col(f"lo{p}")) * part(p)).alias(percentile_name(p)) for p in PERCENTILES]
    return out.select(*GROUP, "intensity_min", "intensity_max", "intensity_mean", stddev.alias("intensity_stddev"), F.col("total").alias("points_count"), *of)


def signature_tables(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures(id, feature_id, sensor_id, campaign_id), entries with their id): ids by the rank of the key, the same in every run."""
    order = ["feature_id", "sensor_id", "campaign_id"]
    ids = ranked(stats.select(*order).distinct(), order, "id").select(F.col("id").cast("long").alias("id"), *order)
    entries = stats.join(ids.withColumnRenamed("id", "signature_id"), order).drop(*order)
    return ids, entries


def exported(stats: DataFrame, sensors: DataFrame, campaigns: DataFrame, features: DataFrame, range_bounds=RANGE_BOUNDS, zenith_bounds=ZENITH_BOUNDS, azimuth_bounds=AZIMUTH_BOUNDS) -> DataFrame:
    """The 32 columns of the signature export: sensors and campaigns have (id, name), features (feature_id, feature_object_id,
    feature_object_name, feature_class_name). Bins outside the bounds stay, with null bounds."""
    name = lambda df, what: df.select(F.col("id").alias(f"{what}_id"), F.col("name").alias(f"{what}_name"))
    joined = stats.join(name(sensors, "sensor"), "sensor_id").join(name(campaigns, "campaign"), "campaign_id").join(features, "feature_id")
    bounds = [bin_bound(F.col(f"{b}_bin"), v, up).alias(f"{n}_bin_{s}") for b, n, v in (("range", "spherical_range", range_bounds), ("zenith", "surface_zenith_angle", zenith_bounds), ("azimuth", "surface_azimuth_angle", azimuth_bounds)) for s, up in (("lower", False), ("upper", True))]
    percentiles = [percentile_name(p) for p in PERCENTILES]
    return joined.select("feature_object_id", "feature_object_name", "feature_class_name", "sensor_id", "sensor_name", "campaign_id", "campaign_name", *bounds, "intensity_mean", "intensity_stddev", "intensity_min", *percentiles, "intensity_max", (F.col("intensity_p75") - F.col("intensity_p25")).alias("intensity_iqr"), F.col("points_count").cast("int").alias("points_count"))


def _plain(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def bin_names(bounds, degrees: bool = False) -> list[str]:
    """'<lower>_<upper>' of each bin: plain numbers, or whole degrees rounded half away from zero."""
    text = [str(math.floor(math.degrees(b) + 0.5)) if degrees else _plain(b) for b in bounds]
    return [f"{a}_{b}" for a, b in zip(text[:-1], text[1:], strict=True)]


def property_label(prefix: str = PREFIX, range_bounds=RANGE_BOUNDS, zenith_bounds=ZENITH_BOUNDS, azimuth_bounds=AZIMUTH_BOUNDS) -> Column:
    """What a signature's property names begin with; null if any bin is."""
    of = lambda column, names: F.element_at(F.array(*map(F.lit, names)), F.col(column))
    text = lambda c: F.col(c).cast("string")
    parts = [F.lit(f"{prefix}sensor_"), text("sensor_id"), F.lit("_campaign_"), text("campaign_id"), F.lit("_range_"), of("range_bin", bin_names(range_bounds)), F.lit("_surface_zenith_angle_"), of("zenith_bin", bin_names(zenith_bounds, True)), F.lit("_surface_azimuth_angle_"), of("azimuth_bin", bin_names(azimuth_bounds, True))]
    return F.concat(*parts)


def as_properties(stats: DataFrame, prefix: str = PREFIX, **bounds) -> DataFrame:
    """(feature_id, datatype_id, namespace_id, name, val_float8, val_int): eight rows for each signature, those without name or value left
    out. Namespace 3; datatype 3 for counts, 4 for numbers."""
    label, none = property_label(prefix, **bounds), F.lit(None)
    rows = [F.struct(F.lit(3 if m == "points_count" else 4).alias("datatype_id"), F.concat(label, F.lit(f"_{m}")).alias("name"), (none if m == "points_count" else F.col(m)).cast("double").alias("val_float8"), (F.col(m) if m == "points_count" else none).cast("long").alias("val_int")) for m in METRICS]
    out = stats.select("feature_id", F.lit(3).alias("namespace_id"), F.inline(F.array(*rows)))
    value = F.when(F.col("datatype_id") == 4, F.col("val_float8").isNotNull()).when(F.col("datatype_id") == 3, F.col("val_int").isNotNull()).otherwise(False)
    return out.where(F.col("name").isNotNull() & value)
