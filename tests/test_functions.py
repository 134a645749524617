"""Values worked out by hand, and the distance kernel against dense sampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamlake.functions import geometry as G
from beamlake.functions import text as T
from beamlake.functions import vector as V
from beamlake.operators import associate, asof, bins, entities, kernel, views
from beamlake.streaming import slices

H, S = math.sqrt(0.5), 10**9
Q = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))


def p(*xyz):
    return V.point(*map(F.lit, map(float, xyz)))


def q(*xyzw):
    return F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(xyzw, "xyzw", strict=True)])


def ring(points):
    return F.array(*[p(*x) for x in points])


def _close(got, want):
    if want is None or got is None:
        return got is None and want is None
    if isinstance(want, tuple):
        return all(_close(got[i], w) for i, w in enumerate(want))
    return abs(got - want) < 1e-7


def line(a, b):
    return p(*a), p(*b)


GOLDEN = {
    "normal_square": (lambda: G.normal(ring(Q)), (0, 0, 1)),
    "normal_wall": (lambda: G.normal(ring(((0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)))), (1, 0, 0)),
    "normal_triangle": (lambda: G.normal(ring(((0, 0, 0), (2, 0, 0), (0, 0, 2)))), (0, -1, 0)),
    "normal_collinear": (lambda: G.normal(ring(((0, 0, 0), (1, 0, 0), (2, 0, 0)))), None),
    "normal_two_points": (lambda: G.normal(ring(((0, 0, 0), (1, 0, 0)))), None),
    "normal_closed": (lambda: G.normal(ring((*Q, Q[0]))), (0, 0, 1)),
    "centroid": (lambda: G.centroid(ring((*Q, Q[0]))), (0.5, 0.5, 0)),
    "zenith_above": (lambda: G.zenith(p(0, 0, 1), *line((0.5, 0.5, 5), (0.5, 0.5, 0))), 0.0),
    "zenith_slanted": (lambda: G.zenith(p(0, 0, 1), *line((-4.5, 0.5, 5), (0.5, 0.5, 0))), math.pi / 4),
    "zenith_from_behind": (lambda: G.zenith(p(0, 0, 1), *line((0.5, 0.5, -5), (0.5, 0.5, 0))), None),
    "azimuth_x": (lambda: G.azimuth(p(0, 0, 1), p(0.5, 0.5, 0), *line((-4.5, 0.5, 5), (0.5, 0.5, 0))), 0.0),
    "azimuth_y": (lambda: G.azimuth(p(0, 0, 1), p(0.5, 0.5, 0), *line((0.5, 5.5, 5), (0.5, 0.5, 0))), 3 * math.pi / 2),
    "plane_before": (lambda: V.line_plane_parameter(p(0.5, 0.5, 0.1), p(0, 0, -5), p(0.5, 0.5, 0), p(0, 0, 1)), 0.1),
    "plane_behind": (lambda: V.line_plane_parameter(p(0.5, 0.5, -0.1), p(0, 0, -5), p(0.5, 0.5, 0), p(0, 0, 1)), -0.1),
    "plane_parallel": (lambda: V.line_plane_parameter(p(0.5, 0.5, 0.1), p(1, 0, 0), p(0.5, 0.5, 0), p(0, 0, 1)), None),
    "rotate": (lambda: V.rotate(p(1, 0, 0), q(0, 0, H, H)), (0, 1, 0)),
    "rotate_back": (lambda: V.rotate(p(1, 0, 0), V.conjugate(q(0, 0, H, H))), (0, -1, 0)),
    "rotate_axes": (lambda: V.rotate(p(1, 2, 3), q(0.5, 0.5, 0.5, 0.5)), (3, 1, 2)),
    "spherical": (lambda: V.spherical(p(1, 1, math.sqrt(2))), (math.pi / 4, math.pi / 4, 2)),
    "spherical_origin": (lambda: V.spherical(p(0, 0, 0)), (None, None, 0)),
    "slerp_half": (lambda: V.slerp(q(0, 0, 0, 1), q(0, 0, 1, 0), F.lit(0.5)), (0, 0, H, H)),
    "slerp_quarter": (lambda: V.slerp(q(0, 0, 0, 1), q(0, 0, H, H), F.lit(0.25)), (0, 0, 0.19509032, 0.98078528)),
    "slerp_short_way": (lambda: V.slerp(q(0, 0, 0, 1), q(0, 0, -H, -H), F.lit(0.5)), (0, 0, 0.38268343, 0.92387953)),
    "slerp_nearly_equal": (lambda: V.slerp(q(0, 0, 0, 1), q(0, 0, 1e-7, math.sqrt(1 - 1e-14)), F.lit(0.5)), None),
    "slerp_nearly_equal_first": (lambda: V.slerp(q(0, 0, 0, 1), q(0, 0, 1e-7, math.sqrt(1 - 1e-14)), F.lit(0.5), degenerate="q1"), (0, 0, 0, 1)),
    "segment_start": (lambda: G.uncertainty_segment(p(0, 0, 0), p(10, 0, 0), 1.0)["p0"], (9.5, 0, 0)),
    "segment_end": (lambda: G.uncertainty_segment(p(0, 0, 0), p(10, 0, 0), 1.0)["p1"], (10.5, 0, 0)),
    "segment_of_no_beam": (lambda: G.uncertainty_segment(p(0, 0, 0), p(0, 0, 0), 1.0), None),
    "envelope_of_null": (lambda: G.make_envelope(p(0, 0, 0), F.lit(None).cast("struct<x:double,y:double,z:double>")), None),
    "corners": (lambda: F.size(G.box_corners(G.box_of(ring(Q)))).cast("double"), 8.0),
    "closed": (lambda: F.size(G.closed(ring((*Q, Q[0])))).cast("double"), 5.0),
}


@pytest.fixture(scope="module")
def golden(spark):
    return spark.range(1).select(*[make().alias(n) for n, (make, _) in GOLDEN.items()]).first()


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(golden, name):
    assert _close(golden[name], GOLDEN[name][1]), golden[name]


def test_pose_in_all_cases(spark):
    poses = spark.createDataFrame([(1, 7, 10 * S, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)), (2, 7, 12 * S, (2.0, 4.0, 6.0), None), (3, 7, 12 * S, (9.0, 9.0, 9.0), None), (4, 7, 200 * S, (5.0, 5.0, 5.0), None)], "id long, trajectory_id int, ts_ns long, position struct<x:double,y:double,z:double>, orientation struct<x:double,y:double,z:double,w:double>").withColumn("sequence_index", F.lit(None).cast("int"))
    lines = spark.createDataFrame([(7, 1, "timed", "linear"), (8, 1, "timed", "step")], "id int, recording_id int, domain string, interpolation_type string")
    points = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate([(1, 9 * S), (1, 10 * S), (1, 10 * S + S // 2), (1, 12 * S), (1, 300 * S), (1, 106 * S), (1, None), (2, 10 * S)])], "k int, recording_id int, ts_ns long")
    for slice_ns in (S, 60 * S, 1000 * S):
        got = {r["k"]: r["sensor_position"] for r in views.sensor_poses(points, lines, poses, slice_ns=slice_ns).collect()}
        assert got[0]["x"] == 0 and got[1]["x"] == 0 and _close(got[2], (0.5, 1, 1.5)) and got[3]["x"] == 9 and got[4]["x"] == 5 and got[6] is None and got[7] is None
        assert _close(got[5], (7.0, 7.0, 7.0))  # from the later of two poses at one time, half way to the last
    with pytest.raises(Exception, match="no pose available"):
        views.sensor_poses(points, lines, poses, strict=True).collect()
    step = asof.interpolated("ts_ns", "step")
    near = asof.neighbours(poses, points.withColumnRenamed("recording_id", "trajectory_id").withColumn("trajectory_id", F.lit(7)), "trajectory_id", "ts_ns", ["position", "orientation"], tie="id")
    assert {r["k"]: r["x"]["x"] for r in near.select("k", step[0].alias("x")).where("k = 2 or k = 5").collect()} == {2: 0.0, 5: 9.0}


def _grid(outer, hole):
    """Points of a plate with a hole, 1/64 apart, and its corners."""
    xs = np.linspace(0, outer, int(outer * 64) + 1)
    x, y = (v.ravel() for v in np.meshgrid(xs, xs))
    keep = ~((x > hole[0]) & (x < hole[1]) & (y > hole[0]) & (y < hole[1]))
    return np.stack([x[keep], y[keep], 0 * x[keep]], axis=1)


def test_kernel_against_sampling(spark):
    """Random points and segments against a turned, shifted plate with a hole."""
    rng = np.random.default_rng(5)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    shift = np.array([4e5, 5e6, 300.0])
    place = lambda x: np.asarray(x, float) @ turn.T + shift
    outer, hole = [place(x) for x in ((0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0))], [place(x) for x in ((0.5, 0.5, 0), (0.5, 1.5, 0), (1.5, 1.5, 0), (1.5, 0.5, 0))]
    plate, normal = _grid(2, (0.5, 1.5)), turn[:, 2]
    a = rng.uniform(-1, 3, (60, 3)) * [1, 1, 0.5]
    b = np.concatenate([a[:30], a[30:] + rng.normal(0, 0.7, (30, 3))])
    want = [min(np.sqrt(((plate - (u + (v - u) * t)) ** 2).sum(1).min()) for t in np.linspace(0, 1, 1 if (u == v).all() else 120)) for u, v in zip(a, b, strict=True)]
    rows = [(i, tuple(map(float, place(u))), tuple(map(float, place(v)))) for i, (u, v) in enumerate(zip(a, b, strict=True))]
    point = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"i int, p {point}, q {point}")
    shape = spark.range(1).select(G.edges(ring(outer), F.array(ring(hole))).alias("e"))
    df = df.crossJoin(F.broadcast(shape))
    got = {r["i"]: r["d"] for part in ("i < 30", "i >= 30") for r in df.where(part).select("i", kernel.polygon_distance(F.col("p"), F.col("q"), F.col("e"), p(*normal)).alias("d")).collect()}
    assert all(-1e-6 < want[i] - got[i] < 0.03 for i in range(60)), [(want[i], got[i]) for i in range(60) if not -1e-6 < want[i] - got[i] < 0.03]
    none = df.withColumn("e", F.when(F.col("i") < 0, F.col("e"))).select(kernel.polygon_distance(F.col("p"), F.col("q"), F.col("e"), p(0, 0, 1)).alias("d"))
    assert {r["d"] for r in none.collect()} == {None}


def test_pairs_over_all_extents(spark):
    """A long thin roof, a small plate and one in between meet the same points as by trying all of them; no pair twice."""
    rng = np.random.default_rng(8)
    plates = [(1, 0, 0, 300, 0.5), (2, 10, 0.2, 1, 1), (3, 50, -3, 20, 9)]
    polygons = spark.createDataFrame([(k, [(float(x + i * w), float(y + j * h), 0.1 * k) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]) for k, x, y, w, h in plates], "id int, exterior array<struct<x:double,y:double,z:double>>")
    polygons = polygons.select("id", "exterior", F.lit(None).cast("array<array<struct<x:double,y:double,z:double>>>").alias("holes"), G.normal(F.col("exterior")).alias("normal"), G.centroid(F.col("exterior")).alias("centroid"))
    pts = rng.uniform([-1, -4, -0.3], [301, 7, 0.9], (3000, 3))
    beams = spark.createDataFrame([(i, tuple(map(float, x)), tuple(map(float, x + [0.4, 0.3, 0]))) for i, x in enumerate(pts)], "i int, p0 struct<x:double,y:double,z:double>, p1 struct<x:double,y:double,z:double>")
    got = sorted((r["i"], r["polygon_id"]) for r in associate.candidates(beams.withColumn("p1", F.col("p0")), polygons, 0.25).collect())
    far = lambda v, lo, n: max(lo - v, v - lo - n, 0)
    want = sorted((i, k) for i, (x, y, z) in enumerate(pts) for k, px, py, w, h in plates if math.dist((far(x, px, w), far(y, py, h), z - 0.1 * k), (0, 0, 0)) <= 0.25)
    assert got == want and len(got) > 100
    pairs = [(r["i"], r["polygon_id"]) for r in associate.candidates(beams, polygons, 0.25).collect()]
    assert len(pairs) == len(set(pairs)) and set(got) <= set(pairs)
    assert associate.candidates(beams, polygons.limit(0), 0.25).count() == 0


def test_entities(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id int, name string")
    assert entities.duplicates(df, ["name"]).count() == 1 and entities.duplicates(df, ["name"], nulls_equal=True).count() == 2
    assert [r["id"] for r in entities.without_pattern(df, "a%").orderBy("id").collect()] == [1, 2]
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "k int, parent int")
    assert {r["k"] for r in entities.cascaded(child, df, "parent").collect()} == {1, 3}
    with pytest.raises(ValueError):
        entities.cropped(df, (0, 0, 0), None)


def test_percentiles_of_few_and_equal_values(spark):
    rows = [(1, 0, 0, v, 1.0, 0.1, 0.1) for v in (1.0, 2.0, 4.0, 8.0, None)] + [(2, 0, 0, 5.0, 1.0, 0.1, 0.1)] + [(3, 0, 0, None, 1.0, 0.1, 0.1), (None, 0, 0, 1.0, 1.0, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "feature_id int, sensor_id int, campaign_id int, intensity double, spherical_range double, surface_zenith_angle double, surface_azimuth_angle double")
    got = {r["feature_id"]: r for r in bins.signature_stats(df).collect()}
    assert (got[1]["intensity_p5"], got[1]["intensity_p25"], got[1]["points_count"]) == (pytest.approx(1.15), 1.75, 4) and got[2]["intensity_stddev"] is None and got[2]["intensity_p95"] == 5
    assert got[3]["points_count"] == 0 and got[3]["intensity_median"] is None and set(got) == {1, 2, 3}


def test_durations_and_stamps():
    assert [T.duration_ns(x) for x in ("5s", "1h 30m", "250ms", "1.5s")] == [5 * S, 5400 * S, S // 4, 3 * S // 2]
    assert T.rfc3339_ns("1970-01-01T01:00:00.000000001+01:00") == 1
    for bad in ("", "5", "x"):
        with pytest.raises(ValueError):
            T.duration_ns(bad)
    assert T.specification_problems("[]") == ["not an object"] and T.specification_problems(None) == [] and T.specification_problems("{") and T.specification_problems('{"a": 1}', {"a": int, "b": str}) == ["b: missing"]


def test_streamed_slices(spark, tmp_path):
    spark.createDataFrame([(t, i) for i in range(12) for t in ("a", "b")], "topic string, s int").select("topic", F.timestamp_seconds(F.col("s")).alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("topic string, ts timestamp").parquet(f"{tmp_path}/in")
    run = slices.slice_counts(stream).writeStream.format("memory").queryName("slices").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination()
    assert sorted(r["messages"] for r in spark.table("slices").collect()) == [2, 2, 5, 5, 5, 5]


def test_numbers(spark):
    from beamlake.operators.numbering import numbered_within, ranked

    df = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(7)).alias("g"), F.hash("id").alias("v")).repartition(5).unionByName(spark.createDataFrame([(3, None)], "g int, v int"))
    got = [r["n"] for r in ranked(df, ["g", "v"]).orderBy(F.col("g"), F.col("v").asc_nulls_last()).collect()]
    assert got == list(range(1, 1002))
    for _, rows in __import__("itertools").groupby(sorted((r["g"], r["k"], r["v"]) for r in numbered_within(df, "g", ["v"], "k").where("v is not null").collect()), key=lambda r: r[0]):
        rows = list(rows)
        assert [r[1] for r in rows] == list(range(len(rows))) and [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert ranked(df.limit(0), ["g"]).count() == 0
