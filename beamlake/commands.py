"""The engine's commands over a store: import, sensor views, association, signatures, statistics, exports, cleaning.

Each is one or a few set-based jobs over whole tables; what is re-run replaces what it wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamlake.operators import bins, features, octree, statistics, views
from beamlake.operators import associate as associating
from beamlake.operators.entities import box_overlap
from beamlake.operators.numbering import numbered_within
from beamlake.schema import TABLES
from beamlake.sources import files, messages
from beamlake.store import Store


def _one(spark: SparkSession, table: str, **values) -> DataFrame:
    schema = spark.createDataFrame([], TABLES[table]).schema
    return spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)


def setup(store: Store, platform: str, sensor: str, campaign: str, mission: str, platform_type: str | None = None, sensor_type: str = "lidar") -> dict[str, int]:
    """Ids of platform, sensor, campaign and mission by name, made where they are missing."""
    spark, out = store.spark, {}

    def pick(table: str, **values) -> int:
        rows = store.get_or_create(table, _one(spark, table, **values))
        for k in ("name", "campaign_id", "platform_id"):
            rows = rows.where(F.col(k).eqNullSafe(F.lit(values[k]))) if k in values else rows
        return rows.agg(F.min("id")).first()[0]

    out["platform_id"] = pick("platform", name=platform, platform_type=platform_type)
    out["sensor_id"] = pick("sensor", platform_id=out["platform_id"], name=sensor, type=sensor_type)
    out["campaign_id"] = pick("campaign", name=campaign)
    out["mission_id"] = pick("mission", campaign_id=out["campaign_id"], name=mission)
    return out


def import_points(store: Store, points: DataFrame, ids: dict[str, int], max_points: int = 100_000, depth: int = 8, metadata_only: bool = False) -> None:
    """points(name, place, position, ts_ns, intensity, point_source_id, sensor_position): a recording and a cloud for each name; ids of
    points count from 0 in each cloud; cells and their points are written, with metadata_only the cells alone."""
    date = lambda f: F.timestamp_micros(F.call_function("div", f("ts_ns"), F.lit(1000)))
    named = points.groupBy("name").agg(date(F.min).alias("start_date"), date(F.max).alias("end_date"))
    recordings = store.register("recording", named.select(F.lit(ids["mission_id"]).alias("mission_id"), F.lit(ids["sensor_id"]).alias("sensor_id"), "name", "start_date", "end_date"))
    clouds = store.register("point_cloud", recordings.select(F.col("id").alias("recording_id"), F.lit(None).cast("string").alias("name"), "start_date", "end_date"))
    known = clouds.select(F.col("id").alias("point_cloud_id"), "recording_id").join(recordings.select(F.col("id").alias("recording_id"), "name"), "recording_id").select("point_cloud_id", "name")
    own = numbered_within(points.join(known, "name").select("point_cloud_id", "place", "position", "ts_ns", "intensity", "point_source_id", "sensor_position"), "point_cloud_id", ["place"], "id")
    flat = own.select("*", "position.x", "position.y", "position.z")
    placed = octree.octants(flat, max_points, depth, by=["point_cloud_id"])
    top = store.read("point_cloud_cell").agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    cells = octree.cells(placed, octree.roots(flat, ["point_cloud_id"])).crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top"))  # one row
    store.append("point_cloud_cell", cells)
    if metadata_only:
        return
    new = store.read("point_cloud_cell").join(known.select("point_cloud_id"), "point_cloud_id", "left_semi")
    key = new.select("point_cloud_id", "level", *[F.col(c).alias(f"cell_{c}") for c in "xyz"], F.col("id").alias("cell_id"))
    rows = placed.join(key, ["point_cloud_id", *octree.CELL])
    store.append("points", rows.withColumn("point_index", F.row_number().over(Window.partitionBy("cell_id").orderBy("id"))))  # a cell has at most max_points


def import_messages(store: Store, recorded: DataFrame, transforms: DataFrame, ids: dict[str, int], start_ns: int, end_ns: int, slice_ns: int = 5 * 10**9, max_points: int = 100_000) -> None:
    """A point cloud for each topic and slice of the messages, in the global frame, and the transforms as trajectories."""
    rows = messages.in_global_frame(messages.sliced_points(recorded, start_ns, end_ns, slice_ns), transforms)
    named = rows.withColumns({"name": F.concat_ws(" ", "topic", "name"), "point_source_id": F.lit(None).cast("int"), "place": F.struct("message_ns", "mcap_chunk_id", "mcap_message_id", "pos")})
    import_points(store, named, ids, max_points)
    import_trajectories(store, transforms, ids)


def import_trajectories(store: Store, transforms: DataFrame, ids: dict[str, int], recording: DataFrame | None = None) -> None:
    """A recording and a trajectory for each path of transforms(path, ts_ns, position, orientation), or, with recording(path,
    recording_id), trajectories of those."""
    kinds = messages.trajectory_kinds(transforms)
    if recording is None:
        made = store.register("recording", kinds.select(F.lit(ids["mission_id"]).alias("mission_id"), F.lit(ids["platform_id"]).alias("platform_id"), F.col("path").alias("name")))
        recording = made.select(F.col("name").alias("path"), F.col("id").alias("recording_id"))
    paths = kinds.join(recording, "path")
    lines = store.register("trajectory", paths.select("recording_id", "domain", "interpolation_type", "extrapolation_type"))
    known = lines.select(F.col("id").alias("trajectory_id"), "recording_id").join(recording, "recording_id").select("trajectory_id", "path")
    store.register("trajectory_pose", messages.as_poses(transforms, kinds).join(known, "path"))


def generate_sensor_views(store: Store, uncertainty: float = 1.0, strict: bool = False) -> None:
    """Poses and beams of every point, from the trajectory of its recording (or of the recording that is its parent)."""
    points = store.read("points")
    of_cloud = store.read("point_cloud").select(F.col("id").alias("point_cloud_id"), "recording_id")
    parents = store.read("recording").select(F.col("id").alias("recording_id"), F.coalesce("parent_id", "id").alias("of"))
    lines = store.read("trajectory")
    own = lines.select("recording_id").distinct().withColumn("own", F.lit(True))
    moving = of_cloud.join(parents, "recording_id").join(own, "recording_id", "left").select("point_cloud_id", F.when(F.col("own"), F.col("recording_id")).otherwise(F.col("of")).alias("recording_id"))
    done = views.sensor_views(points.join(moving, "point_cloud_id", "left"), lines, store.read("trajectory_pose"), uncertainty, strict=strict)
    store.write("points", done)


def explode_surfaces(store: Store) -> None:
    store.write("feature_geometry_data", features.exploded_surfaces(store.read("geometry_data")))


def associate(store: Store, point_buffer: float = 0.5, line_buffer: float = 0.05, max_t: float = 1.0, prefilter: str = "envelope") -> None:
    """Cleans, explodes the surfaces and associates every cell's points with them."""
    explode_surfaces(store)
    polygons = store.read("feature_geometry_data")
    store.write("points", associating.associate(store.read("points"), polygons, "cell_id", "point_index", point_buffer, line_buffer, max_t, prefilter))


def enriched_beams(store: Store) -> DataFrame:
    """One row for each point with sensor, campaign, feature and measures; points without a feature stay."""
    missions = store.read("mission").select(F.col("id").alias("mission_id"), "campaign_id")
    recordings = store.read("recording").select(F.col("id").alias("recording_id"), "mission_id", "sensor_id").where("sensor_id is not null")
    clouds = store.read("point_cloud").select(F.col("id").alias("point_cloud_id"), "recording_id").join(recordings, "recording_id").join(missions, "mission_id").select("point_cloud_id", "sensor_id", "campaign_id")
    surfaces = store.read("feature_geometry_data").select(F.col("id").alias("polygon_id"), "feature_id")
    info = features.feature_info(store.read("feature"), store.read("objectclass"), store.read("property"))
    points = store.read("points").select("point_cloud_id", "polygon_id", "intensity", "spherical_range", F.col("zenith").alias("surface_zenith_angle"), F.col("azimuth").alias("surface_azimuth_angle"), "ts_ns")
    return points.join(clouds, "point_cloud_id").join(surfaces, "polygon_id", "left").join(info, "feature_id", "left")


def estimate_signatures(store: Store, **bounds) -> None:
    ids, entries = bins.signature_tables(bins.signature_stats(enriched_beams(store), **bounds))
    store.write("signature", ids)
    store.write("signature_entry", entries)


def signatures(store: Store) -> DataFrame:
    return store.read("signature").withColumnRenamed("id", "signature_id").join(store.read("signature_entry"), "signature_id")


def export_signatures(store: Store, path: str, **bounds) -> None:
    info = features.feature_info(store.read("feature"), store.read("objectclass"), store.read("property"))
    files.write_parquet(bins.exported(signatures(store), store.read("sensor"), store.read("campaign"), info, **bounds), path)


def enrich_city_model(store: Store, prefix: str = bins.PREFIX, **bounds) -> None:
    """Replaces the properties of the prefix by the signatures' metrics."""
    store.clean_properties(prefix)
    store.append("property", bins.as_properties(signatures(store), prefix, **bounds))


def statistics_document(store: Store, step: float = statistics.RANGE_STEP) -> dict:
    """Only counts are collected: a row for each group of the document."""
    classes = store.read("objectclass").select(F.col("classname").alias("feature_class_name"))
    info = features.feature_info(store.read("feature"), store.read("objectclass"), store.read("property")).where("feature_class_name is not null")
    names = lambda table: {r["id"]: r["name"] for r in store.read(table).select("id", "name").collect()}
    counts = statistics.sensor_counts(enriched_beams(store), step).collect()
    present = [r for r in statistics.model_counts(classes, info.select("feature_id", "feature_class_name", "feature_object_name")).collect()]
    return statistics.document(counts, present, names("sensor"), names("campaign"), step)


def write_statistics(store: Store, path: str, step: float = statistics.RANGE_STEP) -> None:
    files.write_text(store.spark, statistics.as_json(statistics_document(store, step)), path)


def export_point_clouds(store: Store, path: str, file_format: str = "parquet") -> list[str]:
    """All clouds by campaign, mission, sensor, recording and cloud, with resolved features; sensors.json beside them if there are sensors."""
    names = files.cloud_names(*[store.read(t) for t in ("point_cloud", "recording", "sensor", "mission", "campaign")])
    surfaces = store.read("feature_geometry_data").select(F.col("id").alias("polygon_id"), "feature_id")
    properties = store.read("property").where("datatype_id = 14")
    info = features.feature_info(store.read("feature"), store.read("objectclass"), properties)
    points = store.read("points").drop("cell_id", "point_index", "sensor_orientation", "direction", "p0", "p1")
    written = files.export_clouds(points.join(surfaces, "polygon_id", "left").join(info, "feature_id", "left").drop("polygon_id"), names, path, file_format)
    sensors = {r["id"]: {"name": r["name"]} for r in store.read("sensor").collect()}
    if sensors:
        files.write_text(store.spark, statistics.as_json(sensors), path.rstrip("/") + "_sensors.json")
    return written.columns


def export_points_of_feature(store: Store, objectid: str) -> DataFrame:
    """Points associated with a feature."""
    mine = store.read("feature").where(F.col("objectid") == objectid).select(F.col("id").alias("feature_id"))
    polygons = store.read("feature_geometry_data").join(mine, "feature_id", "left_semi").select(F.col("id").alias("polygon_id"))
    return store.read("points").join(polygons, "polygon_id", "left_semi")


def export_feature_list(store: Store, path: str, lo: tuple | None = None, hi: tuple | None = None) -> None:
    files.write_csv(features.feature_list(store.read("feature"), store.read("objectclass"), store.read("property"), lo, hi).orderBy("id"), path, one_file=True)


def crop_city_model(store: Store, lo: tuple, hi: tuple) -> dict[str, int]:
    """Deletes the features outside the box with all that hangs on them; how many there were, are and went."""
    _, counts = features.crop(store.read("feature"), lo, hi)
    found = counts.first().asDict()
    store.delete("feature", ~box_overlap(F.col("envelope"), lo, hi))
    return found


def exclude_classes(store: Store, names: list[str]) -> None:
    """Takes the geometry of classes out before association."""
    store.write("geometry_data", features.without_classes(store.read("geometry_data"), store.read("feature"), store.read("objectclass"), names))


def cell_view(store: Store) -> DataFrame:
    return views.cell_view(store.read("point_cloud_cell"), store.read("point_cloud"), store.read("recording"))


def trajectory_lines(store: Store) -> DataFrame:
    return views.trajectory_lines(*[store.read(t) for t in ("trajectory", "trajectory_pose", "recording", "sensor", "platform")])
