"""The city model: surfaces of its geometries, feature list, cropping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.functions import geometry as G
from beamlake.operators.entities import box_overlap, cropped
from beamlake.operators.numbering import ranked
from beamlake.schema import SURFACES


def exploded_surfaces(geometry_data: DataFrame, types: tuple[str, ...] = SURFACES) -> DataFrame:
    """A row for each polygon of geometries of the given types, with normal (null for no area) and centroid; ids by geometry and place."""
    rows = geometry_data.where(F.col("geom_type").isin(*types)).select(F.col("id").alias("geometry_data_id"), "feature_id", F.posexplode("polygons").alias("place", "polygon"))
    out = rows.select("geometry_data_id", "feature_id", "place", "polygon.exterior", "polygon.holes").withColumns({"normal": G.normal(F.col("exterior")), "centroid": G.centroid(F.col("exterior"))})
    return ranked(out, ["geometry_data_id", "place"], "id").select(F.col("id").cast("long").alias("id"), "geometry_data_id", "feature_id", "exterior", "holes", "normal", "centroid")


def without_classes(geometry_data: DataFrame, features: DataFrame, classes: DataFrame, names: list[str]) -> DataFrame:
    """Geometries but those of features of the named classes."""
    gone = features.join(classes.where(F.col("classname").isin(*names)).select(F.col("id").alias("objectclass_id")), "objectclass_id", "left_semi").select(F.col("id").alias("feature_id"))
    return geometry_data.join(gone, "feature_id", "left_anti").select(*geometry_data.columns)


def property_values(properties: DataFrame, name: str, out: str, namespace: int | None = None, datatype: int | None = None) -> DataFrame:
    """(feature_id, out): values of the property of this name; several of one feature are several rows."""
    rows = properties.where(F.col("name") == name)
    rows = rows if namespace is None else rows.where(F.col("namespace_id") == namespace)
    rows = rows if datatype is None else rows.where(F.col("datatype_id") == datatype)
    return rows.select("feature_id", F.col("val_string").alias(out))


def feature_info(features: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(feature_id, feature_object_id, feature_object_name, feature_class_name); names fan out."""
    named = features.select(F.col("id").alias("feature_id"), F.col("objectid").alias("feature_object_id"), "objectclass_id")
    of_class = classes.select(F.col("id").alias("objectclass_id"), F.col("classname").alias("feature_class_name"))
    return named.join(of_class, "objectclass_id", "left").join(property_values(properties, "name", "feature_object_name", 1), "feature_id", "left").select("feature_id", "feature_object_id", "feature_object_name", "feature_class_name")


def feature_list(features: DataFrame, classes: DataFrame, properties: DataFrame, lo: tuple | None = None, hi: tuple | None = None) -> DataFrame:
    """(id, feature_object_id, feature_class_name, feature_object_name, property_lane_type) of the features that overlap the box; either
    corner may be missing. Features without an envelope fail a corner that is given."""
    chosen = features.where(box_overlap(F.col("envelope"), lo, hi))
    info = feature_info(chosen, classes, properties)
    return info.join(property_values(properties, "opendrive_lane_type", "property_lane_type"), "feature_id", "left").select(F.col("feature_id").alias("id"), "feature_object_id", "feature_class_name", "feature_object_name", "property_lane_type")


def crop(features: DataFrame, lo: tuple, hi: tuple) -> tuple[DataFrame, DataFrame]:
    """(features that stay, one row with number before, after, deleted)."""
    kept = cropped(features, lo, hi)
    inside = box_overlap(F.col("envelope"), lo, hi)
    counts = features.agg(F.count("*").alias("before"), F.count(F.when(inside | inside.isNull(), 1)).alias("after"))
    return kept, counts.withColumn("deleted", F.col("before") - F.col("after"))
