"""From files to exports: import, views, association, signatures, statistics, cropping and cleaning over one small store."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from beamlake import commands
from beamlake.operators import bins
from beamlake.sources import files, messages
from beamlake.sources.pointcloud import read_points
from beamlake.store import ASSOCIATION_COLUMNS, VIEW_COLUMNS, Store

S = 10**9


def _square(x, y, z=0.0, size=1.0):
    return [(x, y, z), (x + size, y, z), (x + size, y + size, z), (x, y + size, z), (x, y, z)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Two recordings of 40 points each over two squares of features 1 and 2; feature 3 lies far off, feature 4 has no envelope."""
    root = tmp_path_factory.mktemp("lake")
    raw = root / "raw" / "deep"
    raw.mkdir(parents=True)
    (root / "raw" / ".hidden.xyz").write_text("9 9 9 1\n")
    for name, x0 in (("a", 0.0), ("b", 3.0)):
        (raw / f"{name}.xyz").write_text("".join(f"{x0 + 0.1 + i % 8 * 0.1:.2f} {0.1 + i // 8 * 0.15:.2f} {0.01 * (i % 3):.2f} {i}\n" for i in range(40)))
    s = Store(spark, f"{root}/store")
    s.init(srid=25832, srs_name="test")
    ids = commands.setup(s, "car", "lidar", "spring", "north", "vehicle")
    assert commands.setup(s, "car", "lidar", "spring", "north", "vehicle") == ids
    points = read_points(spark, f"{root}/raw")
    commands.import_points(s, points.withColumn("ts_ns", F.lit(10 * S) + F.col("place") % 1000 * F.lit(S // 10)), ids, max_points=12, depth=4)
    recordings = s.read("recording").select(F.col("name").alias("path"), F.col("id").alias("recording_id"))
    transforms = spark.createDataFrame(
        [("a", 9 * S, (0.5, 0.5, 5.0), (0.0, 0.0, 0.0, 1.0)), ("a", 15 * S, (0.5, 0.5, 5.0), (0.0, 0.0, 0.0, 1.0)), ("b", 0, (3.5, 0.5, 5.0), (0.0, 0.0, math.sin(0.5), math.cos(0.5)))], messages.TRANSFORM
    )
    commands.import_trajectories(s, transforms, ids, recordings)
    shape = lambda *a: [([dict(zip("xyz", p, strict=True)) for p in _square(*a)], [])]
    box = lambda x: (x, 0.0, 0.0, x + 1, 1.0, 0.1)
    s.append("objectclass", spark.createDataFrame([(1, "Roof"), (2, "Wall"), (3, "Tree")], "id int, classname string"))
    s.append("feature", spark.createDataFrame([(1, "f1", 1, box(0.0)), (2, "f2", 2, box(3.0)), (3, "f3", 2, box(90.0)), (4, "f4", 1, None)], s.read("feature").schema))
    s.append("geometry_data", spark.createDataFrame([(1, 1, "ST_MultiPolygon", shape(0.0, 0.0)), (2, 2, "ST_PolyhedralSurface", shape(3.0, 0.0)), (3, 3, "ST_Polygon", shape(90.0, 0.0))], s.read("geometry_data").schema))
    s.append("property", spark.createDataFrame([(1, 14, 1, "name", "house"), (1, 14, 2, "opendrive_lane_type", "none"), (2, 14, 1, "other", "x")], "feature_id long, datatype_id int, namespace_id int, name string, val_string string"))
    return s, str(root)


def test_import(store):
    s, _ = store
    assert {r["name"] for r in s.read("recording").collect()} == {"a", "b"}
    cells = s.read("point_cloud_cell").collect()
    assert sum(c["point_count"] for c in cells) == 80 and all(c["point_count"] <= 12 or c["level"] == 4 for c in cells)
    assert sorted(c["id"] for c in cells) == list(range(1, len(cells) + 1)) and all(c["sensor_envelope"] is None for c in cells)
    points = s.read("points").collect()
    by = {}
    for p in points:
        by.setdefault(p["point_cloud_id"], []).append(p)
    assert all(sorted(p["id"] for p in ps) == list(range(40)) and all(p["intensity"] == p["id"] for p in ps) for ps in by.values())
    kinds = {r["domain"]: r["interpolation_type"] for r in s.read("trajectory").collect()}
    assert kinds == {"timed": "linear", "sequence": "step"}
    view = commands.cell_view(s).collect()
    assert len(view) == len(cells) and all(v["cell_name"].startswith("Name: ") and v["volume"] > 0 for v in view)
    assert {r["sensor_name"] for r in commands.trajectory_lines(s).collect()} == {"lidar"}


def test_views_association_and_what_follows(store, spark):
    s, root = store
    commands.generate_sensor_views(s)
    points = s.read("points").collect()
    for p in points:
        d = [p["position"][c] - p["sensor_position"][c] for c in "xyz"]
        assert p["sensor_position"]["z"] == 5 and abs(p["spherical_range"] - math.dist(d, (0, 0, 0))) < 1e-9
        turn = 1.0 if p["sensor_position"]["x"] > 3 else 0.0
        if abs(d[0]) + abs(d[1]) > 1e-9:
            assert abs(math.remainder(p["azimuth_angle"] - (math.atan2(d[1], d[0]) - turn), 2 * math.pi)) < 1e-9
    commands.associate(s)
    assert s.read("feature_geometry_data").count() == 2
    points = s.read("points").collect()
    assert len(points) == 80 and all(p["polygon_id"] is not None and abs(p["t"] - p["position"]["z"] / (5 - p["position"]["z"]) * math.dist([p["position"][c] - p["sensor_position"][c] for c in "xyz"], (0, 0, 0)) * 1) < 1e-3 for p in points)
    assert all(abs(p["surface_distance"] - p["position"]["z"]) < 1e-6 for p in points)
    commands.estimate_signatures(s)
    commands.estimate_signatures(s)
    assert s.read("signature").count() == 2 and s.read("signature_entry").agg(F.sum("points_count")).first()[0] == 80
    commands.export_signatures(s, f"{root}/signatures")
    out = spark.read.parquet(f"{root}/signatures")
    assert len(out.columns) == 32 and {r["feature_object_name"] for r in out.collect()} == {"house", None} and {r["sensor_name"] for r in out.collect()} == {"lidar"}
    commands.enrich_city_model(s)
    commands.enrich_city_model(s)
    names = [r["name"] for r in s.read("property").where("namespace_id = 3").collect()]
    assert any("_range_0_15_surface_zenith_angle_0_20_surface_azimuth_angle_0_360_intensity_mean" in n for n in names)
    assert len(names) == 8 * s.read("signature_entry").where("azimuth_bin is not null and zenith_bin is not null").count() - s.read("signature_entry").where("intensity_stddev is null").count()
    found = commands.statistics_document(s)
    assert found["sensor_stats"]["group_sensor"][1] == {"number_of_points": 80, "number_of_associated_points": 80, "number_of_associated_features": 2}
    assert found["city_model_stats"]["group_feature_class_name"]["Tree"] == {"number_of_features": 0, "group_feature_object_name": {}}
    assert found["city_model_stats"]["group_feature_class_name"]["Roof"]["group_feature_object_name"] == {"": {"number_of_features": 1}, "house": {"number_of_features": 1}}
    assert set(found["sensor_stats"]["group_feature_class_name"]) == {"Roof", "Wall"} and found["sensor_stats"]["group_feature_class_name"]["Roof"]["group_feature_object_name"] == {}
    commands.write_statistics(s, f"{root}/statistics")
    text = "\n".join(r[0] for r in spark.read.text(f"{root}/statistics").collect())
    assert json.loads(text)["overview"] == {"sensors": {"1": "lidar"}, "campaigns": {"1": "spring"}, "feature_class_names": ["Roof", "Tree", "Wall"]}
    columns = commands.export_point_clouds(s, f"{root}/clouds")
    assert "feature_object_id" in columns and "point_source_id" not in columns
    back = spark.read.parquet(f"{root}/clouds/campaign=spring/mission=north/sensor=lidar/recording=a").collect()
    assert [r["id"] for r in back] == sorted(r["id"] for r in back) and len(back) == 40
    commands.export_point_clouds(s, f"{root}/clouds", "xyz")
    assert spark.read.option("recursiveFileLookup", "true").text(f"{root}/clouds").count() == 80
    commands.export_feature_list(s, f"{root}/list", lo=(-1, -1, -1))
    rows = spark.read.option("sep", ";").option("header", True).csv(f"{root}/list").collect()
    assert [(r["id"], r["feature_object_name"], r["property_lane_type"]) for r in rows] == [("1", "house", "none"), ("2", None, None), ("3", None, None)]
    assert commands.export_points_of_feature(s, "f1").count() == 40


def test_cleaning_and_cropping(store):
    s, _ = store
    s.clean_associations()
    assert s.read("feature_geometry_data").count() == 0 and s.read("points").where(" or ".join(f"{c} is not null" for c in ASSOCIATION_COLUMNS)).count() == 0
    assert commands.crop_city_model(s, (-1, -1, -1), (10, 10, 10)) == {"before": 4, "after": 3, "deleted": 1}
    assert s.read("geometry_data").count() == 2 and s.read("feature").count() == 3
    with pytest.raises(ValueError):
        commands.crop_city_model(s, (0, 0, 0), None)
    commands.exclude_classes(s, ["Wall"])
    assert s.read("geometry_data").count() == 1
    s.clean_properties()
    assert s.read("property").where("namespace_id = 3").count() == 0 and s.read("property").count() == 3
    s.clean_sensor_views()
    assert s.read("points").where(" or ".join(f"{c} is not null" for c in VIEW_COLUMNS)).count() == 0
    with pytest.raises(ValueError, match="duplicate"):
        s.register("recording", s.read("recording"), on_duplicate="error")
    with pytest.raises(ValueError, match="unknown platform_type"):
        commands.setup(s, "ship", "x", "c", "m", "ship")
    s.delete("campaign", F.col("name") == "spring")
    assert [s.read(t).count() for t in ("mission", "recording", "points", "trajectory_pose", "sensor")] == [0, 0, 0, 0, 1]
    s.clean_all()
    s.drop_all()
    assert s.read("feature").count() == 0 and s.lookup("srs", srid=1).count() == 0


def test_messages(spark, tmp_path):
    rows = [(t, i * S, i // 3, i, "lidar", [((float(i), 0.0, 0.0), None, 1.0), ((0.0, 1.0, 0.0), i * S + 5, 2.0)]) for i in range(11) for t in ("/a", "/b")]
    spark.createDataFrame(rows, messages.MESSAGE).write.parquet(f"{tmp_path}/bag")
    assert messages.clamped_span(0, 10 * S, offset=S, duration=20 * S) == (S, 10 * S, ["end is outside the recording"])
    assert messages.clamped_span(0, 10, 3, 0, 7, 99) == (3, 7, []) and messages.slice_count(0, 10 * S, 5 * S) == 2
    found = messages.sliced_points(messages.scan_messages(spark, f"{tmp_path}/bag", ["/a"], end_ns=10 * S), 0, 10 * S)
    by = {r["slice"]: r["count"] for r in found.groupBy("slice").count().collect()}
    assert by == {0: 10, 1: 12}
    assert {r["name"] for r in found.select("name").distinct().collect()} == {"1970-01-01T00:00:00.000000000Z-1970-01-01T00:00:05.000000000Z", "1970-01-01T00:00:05.000000000Z-1970-01-01T00:00:10.000000000Z"}
    moving = spark.createDataFrame([("lidar", 0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)), ("lidar", 10 * S, (10.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0))], messages.TRANSFORM)
    put = messages.in_global_frame(found, moving).where("pos = 0").collect()
    assert sorted(r["position"]["x"] for r in put) == [2.0 * i for i in range(11)]
    s = Store(spark, f"{tmp_path}/store")
    s.init()
    commands.import_messages(s, messages.scan_messages(spark, f"{tmp_path}/bag"), moving, commands.setup(s, "p", "s", "c", "m"), 0, 10 * S)
    assert s.read("point_cloud").count() == 4 and s.read("points").count() == 44 and s.read("trajectory_pose").count() == 2


def test_las_and_compressed_xyz(spark, tmp_path):
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    head[94:96], head[96:100], head[104], head[105:107], head[107:111] = struct.pack("<H", 227), struct.pack("<I", 227), 1, struct.pack("<H", 28), struct.pack("<I", 3)
    head[131:155], head[155:179] = struct.pack("<3d", 0.01, 0.01, 0.01), struct.pack("<3d", 100.0, 0.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBHd", i, 2 * i, 3 * i, 7 + i, 0, 0, 0, 0, 5, 1.5 + i) for i in range(3))
    (tmp_path / "p.las").write_bytes(bytes(head) + body)
    rows = read_points(spark, f"{tmp_path}/p.las", "las").orderBy("place").collect()
    assert [(round(r["position"]["x"], 6), r["intensity"], r["ts_ns"], r["point_source_id"], r["name"]) for r in rows] == [(100 + i / 100, 7 + i, (3 + 2 * i) * S // 2, 5, "p") for i in range(3)]
    import zstandard

    (tmp_path / "q.xyz.zst").write_bytes(zstandard.compress(b"1 2 3\n4 5 6 7\n"))
    rows = read_points(spark, str(tmp_path), "xyz.zst").orderBy("place").collect()
    assert [(r["position"]["x"], r["intensity"], r["name"]) for r in rows] == [(1.0, None, "q"), (4.0, 7.0, "q")]
    with pytest.raises(ValueError):
        read_points(spark, str(tmp_path), "e57")


def test_parquet_text_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b"), (2, None)], "id int, name string")
    files.write_csv(df, f"{tmp_path}/c", one_file=True)
    files.write_csv(df, f"{tmp_path}/c", one_file=True)
    assert spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/c").count() == 2
    assert bins.bin_names((0, 15, 30.5)) == ["0_15", "15_30.5"] and bins.bin_names(bins.ZENITH_BOUNDS, True) == ["0_20", "20_40", "40_60", "60_90"]
