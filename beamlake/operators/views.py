"""Sensor views: the pose of the sensor at each point, and the beam from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamlake.functions.geometry import uncertainty_segment
from beamlake.functions.vector import add, conjugate, let, rotate, scale, slerp, spherical, sub
from beamlake.operators.asof import SLICE_NS, neighbours, ratio

#: Attributes that sensor views write, and association writes.
VIEW_ATTRIBUTES = ("sensor_position", "sensor_orientation", "direction", "azimuth_angle", "elevation_angle", "spherical_range", "p0", "p1")


def one_trajectory(trajectories: DataFrame) -> DataFrame:
    """Of several trajectories of a recording that of the least id."""
    rest = [c for c in trajectories.columns if c != "recording_id"]
    return trajectories.groupBy("recording_id").agg(F.min(F.struct("id", *[c for c in rest if c != "id"])).alias("t")).select("recording_id", *[F.col(f"t.{c}").alias(c) for c in rest])


def sequence_pose(poses: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """The last pose of each trajectory by sequence index: a pose without one is the last of all; of equals the largest id."""
    last = F.max(F.struct(F.col("sequence_index").isNull().alias("none"), F.col("sequence_index").alias("i"), F.col("id").alias("pose_id"), "position", "orientation")).alias("last")
    return poses.groupBy(key).agg(last).select(key, "last.position", "last.orientation")


def sensor_poses(points: DataFrame, trajectories: DataFrame, poses: DataFrame, degenerate: str = "null", strict: bool = False, slice_ns: int = SLICE_NS) -> DataFrame:
    """points(recording_id, ts_ns, ...) with sensor_position and sensor_orientation.

    A timed trajectory is interpolated (linear or step) and extended by its ends; a sequence has its last pose whatever the time. Without a
    trajectory, a pose or a time the pose is null; strict: that is an error."""
    points = points.drop("sensor_position", "sensor_orientation")
    kinds = one_trajectory(trajectories).select("recording_id", F.col("id").alias("trajectory_id"), "domain", "interpolation_type")
    rows = points.join(kinds, "recording_id", "left")
    near = neighbours(poses, rows, "trajectory_id", "ts_ns", ["position", "orientation"], tie="id", slice_ns=slice_ns)
    static = sequence_pose(poses).select("trajectory_id", F.struct("position", "orientation").alias("static"))
    near = near.join(static, "trajectory_id", "left")
    p, n, q, linear = F.col("prev"), F.col("next"), F.col("ts_ns"), F.col("interpolation_type") == "linear"
    t, both, outside = ratio(q, p["ts_ns"], n["ts_ns"]), p.isNotNull() & n.isNotNull() & (p["ts_ns"] != q), F.coalesce(p, n)
    moved = F.when(linear, add(p["position"], scale(sub(n["position"], p["position"]), t))).otherwise(p["position"])
    turned = F.when(linear & n["orientation"].isNotNull() & p["orientation"].isNotNull(), slerp(p["orientation"], n["orientation"], t, degenerate)).otherwise(p["orientation"])
    timed = F.col("domain") == "timed"
    position = F.when(timed & q.isNotNull(), F.when(both, moved).otherwise(outside["position"])).when(F.col("domain") == "sequence", F.col("static.position"))
    orientation = F.when(timed & q.isNotNull(), F.when(both, turned).otherwise(outside["orientation"])).when(F.col("domain") == "sequence", F.col("static.orientation"))
    if strict:
        position = F.coalesce(position, F.raise_error(F.lit("no pose available")).cast("struct<x:double,y:double,z:double>"))
    return near.select(*points.columns, position.alias("sensor_position"), orientation.alias("sensor_orientation"))


def beams(points: DataFrame, uncertainty: float = 1.0) -> DataFrame:
    """points(position, sensor_position, sensor_orientation, ...) with direction, spherical coordinates in the sensor's frame and p0, p1."""
    points = points.drop("direction", "azimuth_angle", "elevation_angle", "spherical_range", "p0", "p1")
    away: Column = sub(F.col("position"), F.col("sensor_position"))
    known = F.col("position").isNotNull() & F.col("sensor_position").isNotNull()
    out = points.withColumn("direction", F.when(known, away))
    local = let(F.when(F.col("sensor_orientation").isNotNull(), conjugate(F.col("sensor_orientation"))), lambda q: rotate(F.col("direction"), q))
    segment = uncertainty_segment(F.col("sensor_position"), F.col("position"), uncertainty)
    out = out.withColumns({"_s": F.when(F.col("sensor_orientation").isNotNull(), spherical(local)), "_u": segment})
    return out.select(*points.columns, "direction", F.col("_s.azimuth").alias("azimuth_angle"), F.col("_s.elevation").alias("elevation_angle"), F.col("_s.range").alias("spherical_range"), F.col("_u.p0").alias("p0"), F.col("_u.p1").alias("p1"))


def sensor_views(points: DataFrame, trajectories: DataFrame, poses: DataFrame, uncertainty: float = 1.0, **options) -> DataFrame:
    return beams(sensor_poses(points, trajectories, poses, **options), uncertainty)


def cell_view(cells: DataFrame, clouds: DataFrame, recordings: DataFrame) -> DataFrame:
    """Cells with a readable name, times in whole seconds (rounded), extent, volume and density (null for no volume)."""
    joined = cells.join(clouds.select(F.col("id").alias("point_cloud_id"), "recording_id"), "point_cloud_id").join(recordings.select(F.col("id").alias("recording_id"), F.col("name").alias("recording_name")), "recording_id")
    box, seconds = F.col("cell_envelope"), lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    volume = (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"]) * (box["zmax"] - box["zmin"])
    text = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("Name: "), F.coalesce(text("recording_name"), F.lit("Unknown")), F.lit(", Octant: level="), text("level"), F.lit(",x="), text("x"), F.lit(",y="), text("y"), F.lit(",z="), text("z"))
    return joined.select(
        "id", name.alias("cell_name"), "recording_name", "point_cloud_id", F.col("level").alias("octant_index_level"), *[F.col(c).alias(f"octant_index_{c}") for c in "xyz"], "start_date", "end_date",
        F.round(seconds("start_date")).cast("int").alias("start_date_timestamp"), F.round(seconds("end_date")).cast("int").alias("end_date_timestamp"), F.round(seconds("end_date") - seconds("start_date")).cast("int").alias("duration"),
        volume.alias("volume"), "point_count", F.try_divide(F.col("point_count"), volume).alias("points_per_cubic_meter"), *[box[f"{c}{s}"].alias(f"{c}_{s}") for s in ("min", "max") for c in "xyz"], "point_envelope", "cell_envelope",
    )


def trajectory_lines(trajectories: DataFrame, poses: DataFrame, recordings: DataFrame, sensors: DataFrame, platforms: DataFrame) -> DataFrame:
    """(id, sensor_name, platform_name, line): positions in the order of time (then pose id)."""
    place = F.transform(F.array_sort(F.collect_list(F.struct("ts_ns", F.col("id").alias("pose_id"), "position"))), lambda r: r["position"])
    lines = poses.groupBy("trajectory_id").agg(place.alias("line"))
    named = trajectories.select("id", "recording_id").join(recordings.select(F.col("id").alias("recording_id"), "sensor_id", "platform_id"), "recording_id")
    named = named.join(sensors.select(F.col("id").alias("sensor_id"), F.col("name").alias("sensor_name")), "sensor_id", "left").join(platforms.select(F.col("id").alias("platform_id"), F.col("name").alias("platform_name")), "platform_id", "left")
    return named.join(lines, F.col("id") == F.col("trajectory_id")).select("id", "sensor_name", "platform_name", "line")
