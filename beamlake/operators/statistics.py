"""The statistics document: all its counts in one aggregation over the beams, and one over the city model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Size of a range bin in metres.
RANGE_STEP = 15.0
#: Name of each grouping and what it groups by.
LEVELS = {
    "overview": (),
    "sensor": ("sensor_id",),
    "campaign": ("campaign_id",),
    "campaign_range": ("campaign_id", "range_bin"),
    "class": ("feature_class_name",),
    "class_campaign_sensor": ("feature_class_name", "campaign_id", "sensor_id"),
    "class_name_campaign_sensor": ("feature_class_name", "feature_object_name", "campaign_id", "sensor_id"),
}
COLUMNS = ("sensor_id", "campaign_id", "range_bin", "feature_class_name", "feature_object_name")


def sensor_counts(beams: DataFrame, step: float = RANGE_STEP) -> DataFrame:
    """(level, COLUMNS, points, associated, features) for every grouping of LEVELS.

    Beams are first counted by the finest combination (partial sums); only these counts are expanded into groupings. Rows without a range
    are in no range bin, rows without a class in no class; a missing object name is an empty one."""
    name = F.when(F.col("feature_class_name").isNotNull(), F.coalesce("feature_object_name", F.lit("")))
    fine = beams.select("sensor_id", "campaign_id", F.floor(F.col("spherical_range") / step).alias("range_bin"), "feature_class_name", name.alias("feature_object_name"), "feature_object_id")
    fine = fine.groupBy(*COLUMNS, "feature_object_id").agg(F.count("*").alias("n"))
    needed = {"campaign_range": "range_bin", "class": "feature_class_name", "class_campaign_sensor": "feature_class_name", "class_name_campaign_sensor": "feature_class_name"}
    grouped = []
    for level, by in LEVELS.items():
        use = F.col(needed[level]).isNotNull() if level in needed else F.lit(True)
        fields = [(F.col(c) if c in by else F.lit(None).cast(fine.schema[c].dataType)).alias(c) for c in COLUMNS]
        grouped.append(F.when(use, F.struct(F.lit(level).alias("level"), *fields)))
    rows = fine.select(F.explode(F.array_compact(F.array(*grouped))).alias("g"), "feature_object_id", "n").select("g.*", "feature_object_id", "n")
    once = rows.groupBy("level", *COLUMNS, "feature_object_id").agg(F.sum("n").alias("n"))  # a row for each feature of a group: counting them is counting rows
    return once.groupBy("level", *COLUMNS).agg(F.sum("n").alias("points"), F.coalesce(F.sum(F.when(F.col("feature_object_id").isNotNull(), F.col("n"))), F.lit(0)).alias("associated"), F.count("feature_object_id").alias("features"))


def model_counts(classes: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_class_name, feature_object_name, features): features(feature_id, feature_class_name, feature_object_name) of each class and
    name; classes without features stay with a null name and 0."""
    joined = classes.select("feature_class_name").join(features, "feature_class_name", "left")
    name = F.when(F.col("feature_id").isNotNull(), F.coalesce("feature_object_name", F.lit("")))
    return joined.groupBy("feature_class_name", name.alias("feature_object_name")).agg(F.count("feature_id").alias("features"))


def document(counts: list[Row], model: list[Row], sensors: dict, campaigns: dict, step: float = RANGE_STEP) -> dict:
    """The document of collected counts (a few numbers for each group). Sensor statistics are left out where there are no points."""
    at: dict[str, list[Row]] = {}
    for r in counts:
        at.setdefault(r["level"], []).append(r)
    three = lambda r: {"number_of_points": r["points"], "number_of_associated_points": r["associated"], "number_of_associated_features": r["features"]}
    two = lambda r: {"number_of_associated_points": r["points"], "number_of_associated_features": r["features"]}
    city: dict = {}
    for r in model:
        c = city.setdefault(r["feature_class_name"], {"number_of_features": 0, "group_feature_object_name": {}})
        c["number_of_features"] += r["features"]
        if r["feature_object_name"] is not None:
            c["group_feature_object_name"][r["feature_object_name"]] = {"number_of_features": r["features"]}
    classes = {r["feature_class_name"]: {"number_of_features": r["features"], "number_of_associated_points": r["points"], "group_feature_object_name": {}, "group_campaign_sensor": {}, "group_feature_object_name_campaign_sensor": {}} for r in at.get("class", []) if r["features"]}
    for r in at.get("class_campaign_sensor", []):
        if r["feature_class_name"] in classes:
            classes[r["feature_class_name"]]["group_campaign_sensor"].setdefault(r["campaign_id"], {})[r["sensor_id"]] = two(r)
    for r in at.get("class_name_campaign_sensor", []):
        if r["feature_class_name"] in classes:
            by_name = classes[r["feature_class_name"]]["group_feature_object_name_campaign_sensor"]
            by_name.setdefault(r["feature_object_name"], {}).setdefault(r["campaign_id"], {})[r["sensor_id"]] = two(r)
    campaign = {r["campaign_id"]: three(r) | {"group_spherical_range": {}} for r in at.get("campaign", [])}
    for r in at.get("campaign_range", []):
        campaign[r["campaign_id"]]["group_spherical_range"][r["range_bin"]] = {"spherical_range_bin_min": r["range_bin"] * step, "spherical_range_bin_max": (r["range_bin"] + 1) * step} | three(r)
    overview = at.get("overview", [])
    found = None
    if overview:
        found = {"number_of_associated_features": overview[0]["features"], "group_sensor": {r["sensor_id"]: three(r) for r in at["sensor"]}, "group_campaign": campaign, "group_feature_class_name": classes}
    return {"overview": {"sensors": sensors, "campaigns": campaigns, "feature_class_names": sorted(city)}, "city_model_stats": {"number_of_features": sum(c["number_of_features"] for c in city.values()), "group_feature_class_name": city}, "sensor_stats": found}


def as_json(found: dict) -> str:
    """Pretty, with sorted keys, whatever their types."""
    def plain(x):
        return {str(k): plain(v) for k, v in sorted(x.items(), key=lambda i: (isinstance(i[0], str), i[0]))} if isinstance(x, dict) else x

    return json.dumps(plain(found), indent=2, ensure_ascii=False)
