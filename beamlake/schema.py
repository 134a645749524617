"""Tables of the engine: their columns, domains and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT, QUATERNION = "struct<x:double,y:double,z:double>", "struct<x:double,y:double,z:double,w:double>"
BOX = "struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>"
TABLES = {
    "platform": "id int, name string, platform_type string, description string",
    "sensor": "id int, platform_id int, name string, manufacturer string, type string, model_number string, specification string",
    "campaign": "id int, name string",
    "mission": "id int, campaign_id int, name string",
    "recording": "id int, parent_id int, mission_id int, platform_id int, sensor_id int, name string, start_date timestamp, end_date timestamp",
    "trajectory": "id int, recording_id int, domain string, interpolation_type string, extrapolation_type string",
    "trajectory_pose": f"id long, trajectory_id int, ts_ns long, sequence_index int, position {POINT}, orientation {QUATERNION}",
    "point_cloud": "id int, recording_id int, name string, start_date timestamp, end_date timestamp",
    "point_cloud_cell": f"id long, point_cloud_id int, level int, x int, y int, z int, start_date timestamp, end_date timestamp, cell_envelope {BOX}, point_envelope {BOX}, sensor_envelope {BOX}, point_count long",
    "points": f"point_cloud_id int, cell_id long, point_index int, id long, position {POINT}, ts_ns long, intensity float, point_source_id int, sensor_position {POINT}, sensor_orientation {QUATERNION}, direction {POINT}, azimuth_angle double, elevation_angle double, spherical_range double, p0 {POINT}, p1 {POINT}, polygon_id long, surface_distance float, beam_distance float, zenith float, azimuth float, t float",
    "feature": f"id long, objectid string, objectclass_id int, envelope {BOX}",
    "objectclass": "id int, classname string",
    "property": "feature_id long, datatype_id int, namespace_id int, name string, val_string string, val_float8 double, val_int long",
    "geometry_data": f"id long, feature_id long, geom_type string, polygons array<struct<exterior:array<{POINT}>,holes:array<array<{POINT}>>>>",
    "feature_geometry_data": f"id long, geometry_data_id long, feature_id long, exterior array<{POINT}>, holes array<array<{POINT}>>, normal {POINT}, centroid {POINT}",
    "signature": "id long, feature_id long, sensor_id int, campaign_id int",
    "signature_entry": "signature_id long, range_bin int, zenith_bin int, azimuth_bin int, intensity_min float, intensity_max float, intensity_mean double, intensity_stddev double, points_count long, " + ", ".join(f"intensity_{p} double" for p in ("p5", "p10", "p20", "p25", "p30", "p40", "median", "p60", "p70", "p75", "p80", "p90", "p95")),
    "srs": "srid int, name string",
}
#: Columns whose values together stand at most once (null keys never collide, as in SQL).
UNIQUE = {"platform": ("name",), "sensor": ("platform_id", "name", "type"), "campaign": ("name",), "mission": ("campaign_id", "name"), "recording": ("mission_id", "platform_id", "sensor_id", "name"), "point_cloud": ("recording_id", "name")}
#: Child table: (its column, parent table). A row whose parent goes, goes.
PARENTS = {
    "sensor": (("platform_id", "platform"),), "mission": (("campaign_id", "campaign"),), "recording": (("mission_id", "mission"), ("platform_id", "platform"), ("sensor_id", "sensor")), "trajectory": (("recording_id", "recording"),),
    "trajectory_pose": (("trajectory_id", "trajectory"),), "point_cloud": (("recording_id", "recording"),), "point_cloud_cell": (("point_cloud_id", "point_cloud"),), "points": (("point_cloud_id", "point_cloud"), ("cell_id", "point_cloud_cell")),
    "property": (("feature_id", "feature"),), "geometry_data": (("feature_id", "feature"),), "feature_geometry_data": (("geometry_data_id", "geometry_data"),), "signature": (("feature_id", "feature"),), "signature_entry": (("signature_id", "signature"),),
}
PLATFORM_TYPES, SENSOR_TYPES = ("vehicle", "uav", "tripod", "static"), ("lidar", "camera", "radar")
DOMAINS, INTERPOLATIONS, EXTRAPOLATIONS = ("timed", "sequence"), ("step", "linear"), ("constant",)
#: Geometry types that are exploded into surfaces.
SURFACES = ("ST_PolyhedralSurface", "ST_MultiPolygon")


def checks(table: str) -> dict[str, Column]:
    """Named conditions that each row must not fail; null is no failure."""
    filled = lambda c: F.char_length(F.col(c)) > 0
    among = lambda c, values: F.col(c).isin(*values)
    ordered = F.col("end_date") >= F.col("start_date")
    found = {
        "platform": {"name is empty": filled("name"), "unknown platform_type": among("platform_type", PLATFORM_TYPES)},
        "sensor": {"name is empty": filled("name"), "unknown type": among("type", SENSOR_TYPES)},
        "campaign": {"name is empty": filled("name")},
        "mission": {"name is empty": filled("name")},
        "recording": {"name is empty": filled("name"), "end before start": ordered},
        "trajectory": {"unknown domain": among("domain", DOMAINS), "unknown interpolation": among("interpolation_type", INTERPOLATIONS), "unknown extrapolation": among("extrapolation_type", EXTRAPOLATIONS)},
        "trajectory_pose": {"no position": F.coalesce(F.col("position").isNotNull(), F.lit(False))},
        "point_cloud": {"end before start": ordered},
        "point_cloud_cell": {"end before start": ordered, "negative count": F.col("point_count") >= 0},
    }
    return found.get(table, {})


def conforming(df: DataFrame, table: str) -> DataFrame:
    """The columns of the table in their order and types; missing ones are null, others are dropped."""
    schema = df.sparkSession.createDataFrame([], TABLES[table]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
