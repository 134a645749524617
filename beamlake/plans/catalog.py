"""Registered queries of the sensor engine and, beside each, the SQL that gives the same rows.

The model is derived from the supplied tables by plain arithmetic: a line item is a beam, a supplier a surface feature with its nation as
class, click events are trajectory poses, other events are timed points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.functions import geometry as G
from beamlake.functions import vector as V
from beamlake.operators import asof, associate, bins, entities, octree, payload
from beamlake.sources.messages import slice_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def enriched(spark: SparkSession, sf: str, names: bool = True, classes: bool = True) -> DataFrame:
    """One row for each beam with sensor, campaign, feature and measures; unassociated beams are kept. names and classes: join the object
    name, and the feature's id and class, only for queries that use them (both joins are to unique keys)."""
    t = lambda n: _t(spark, sf, n)
    feature = F.when((F.col("l_linenumber") == 7) | (F.col("l_quantity") < 5), None).otherwise(F.col("l_suppkey"))
    beams = t("lineitem").join(t("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    beams = beams.select(
        F.col("l_returnflag").alias("sensor_id"), F.col("o_orderpriority").alias("campaign_id"), feature.alias("feature_id"), F.col("l_quantity").alias("intensity"),
        (F.col("l_extendedprice") / 105).alias("spherical_range"), (F.col("l_discount") * 15).alias("surface_zenith_angle"), (F.col("l_tax") * 75).alias("surface_azimuth_angle"), "l_partkey",
    )
    if names:
        beams = beams.join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("feature_object_name")), "l_partkey", "left").withColumn("feature_object_name", F.when(F.col("feature_id").isNotNull(), F.col("feature_object_name")))
    if classes:
        info = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("feature_id"), F.col("s_name").alias("feature_object_id"), F.col("n_name").alias("feature_class_name"))
        beams = beams.join(info, "feature_id", "left")
    return beams.drop("l_partkey")


_BEAMS = """WITH beams AS (SELECT l_returnflag AS sensor_id, o_orderpriority AS campaign_id, f.feature_id, l_quantity AS intensity, l_extendedprice / 105 AS spherical_range, l_discount * 15 AS surface_zenith_angle, l_tax * 75 AS surface_azimuth_angle,
 s_name AS feature_object_id, n_name AS feature_class_name, CASE WHEN f.feature_id IS NOT NULL THEN p_type END AS feature_object_name
 FROM (SELECT *, CASE WHEN l_linenumber = 7 OR l_quantity < 5 THEN NULL ELSE l_suppkey END AS feature_id FROM lineitem) f JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = f.feature_id LEFT JOIN nation ON n_nationkey = s_nationkey) """
_COUNTS = "count(*) AS points, count(feature_object_id) AS associated, count(DISTINCT feature_object_id) AS features"


def _counts() -> list:
    return [F.count("*").alias("points"), F.count("feature_object_id").alias("associated"), F.count_distinct("feature_object_id").alias("features")]


@query(_BEAMS + f"SELECT {_COUNTS} FROM beams")
def overview_counts(spark, sf):
    return enriched(spark, sf, names=False).agg(*_counts())


@query(_BEAMS + f"SELECT sensor_id, {_COUNTS} FROM beams GROUP BY ALL")
def sensor_stats(spark, sf):
    return enriched(spark, sf, names=False).groupBy("sensor_id").agg(*_counts())


@query(_BEAMS + f"SELECT campaign_id, {_COUNTS} FROM beams GROUP BY ALL")
def campaign_stats(spark, sf):
    return enriched(spark, sf, names=False).groupBy("campaign_id").agg(*_counts())


@query(_BEAMS + f"SELECT campaign_id, CAST(floor(spherical_range / 15.0) AS BIGINT) AS bin, CAST(floor(spherical_range / 15.0) AS BIGINT) * 15.0::DOUBLE AS lower_bound, (CAST(floor(spherical_range / 15.0) AS BIGINT) + 1) * 15.0::DOUBLE AS upper_bound, {_COUNTS} FROM beams WHERE spherical_range IS NOT NULL GROUP BY ALL")
def range_histogram(spark, sf):
    b = enriched(spark, sf, names=False).where("spherical_range is not null").groupBy("campaign_id", F.floor(F.col("spherical_range") / 15.0).alias("bin")).agg(*_counts())
    return b.withColumns({"lower_bound": F.col("bin") * 15.0, "upper_bound": (F.col("bin") + 1) * 15.0})


@query("SELECT n_name AS feature_class_name, coalesce(s_name, '') AS feature_object_name, count(s_suppkey) AS features FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def class_name_counts(spark, sf):
    joined = _t(spark, sf, "nation").join(_t(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_name").alias("feature_class_name"), F.coalesce("s_name", F.lit("")).alias("feature_object_name")).agg(F.count("s_suppkey").alias("features"))


@query(_BEAMS + "SELECT feature_class_name, campaign_id, sensor_id, count(*) AS points, count(DISTINCT feature_object_id) AS features FROM beams WHERE feature_class_name IS NOT NULL GROUP BY ALL")
def class_campaign_sensor(spark, sf):
    return enriched(spark, sf, names=False).where("feature_class_name is not null").groupBy("feature_class_name", "campaign_id", "sensor_id").agg(*_counts()).drop("associated")


@query(_BEAMS + "SELECT feature_class_name, coalesce(feature_object_name, '') AS feature_object_name, campaign_id, sensor_id, count(*) AS points, count(DISTINCT feature_object_id) AS features FROM beams WHERE feature_class_name IS NOT NULL GROUP BY ALL")
def class_name_campaign_sensor(spark, sf):
    b = enriched(spark, sf).where("feature_class_name is not null")
    return b.groupBy("feature_class_name", F.coalesce("feature_object_name", F.lit("")).alias("feature_object_name"), "campaign_id", "sensor_id").agg(*_counts()).drop("associated")


@query(_BEAMS + "SELECT feature_class_name, count(DISTINCT feature_id) AS features, count(*) AS associated FROM beams WHERE feature_class_name IS NOT NULL GROUP BY ALL HAVING count(DISTINCT feature_id) > 0")
def class_totals(spark, sf):
    return enriched(spark, sf, names=False).where("feature_class_name is not null").groupBy("feature_class_name").agg(F.count_distinct("feature_id").alias("features"), F.count("*").alias("associated")).where("features > 0")


@query(_BEAMS + "SELECT DISTINCT feature_id, sensor_id, campaign_id FROM beams WHERE feature_id IS NOT NULL")
def distinct_features(spark, sf):
    return enriched(spark, sf, names=False, classes=False).where("feature_id is not null").select("feature_id", "sensor_id", "campaign_id").distinct()


def _case(value: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {float(a)!r}::DOUBLE AND {value} < {float(b)!r}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1)) + " END"


_BINS = f"{_case('spherical_range', bins.RANGE_BOUNDS)} AS range_bin, {_case('surface_zenith_angle', bins.ZENITH_BOUNDS)} AS zenith_bin, {_case('surface_azimuth_angle', bins.AZIMUTH_BOUNDS)} AS azimuth_bin"
_P = ", ".join(f"round(quantile_cont(intensity, {p / 100}), 6) AS intensity_{'median' if p == 50 else f'p{p}'}" for p in bins.PERCENTILES)
_STATS = f"stats AS (SELECT feature_id, sensor_id, campaign_id, {_BINS}, min(intensity) AS intensity_min, max(intensity) AS intensity_max, round(avg(intensity), 6) AS intensity_mean, round(stddev_samp(intensity), 6) AS intensity_stddev, {_P}, count(intensity) AS points_count FROM beams WHERE feature_id IS NOT NULL GROUP BY ALL)"


@query(_BEAMS + f"SELECT {_BINS}, count(*) AS points FROM beams GROUP BY ALL")
def signature_bins(spark, sf):
    b = enriched(spark, sf, names=False, classes=False)
    return b.groupBy(bins.bin_index(F.col("spherical_range"), bins.RANGE_BOUNDS).alias("range_bin"), bins.bin_index(F.col("surface_zenith_angle"), bins.ZENITH_BOUNDS).alias("zenith_bin"), bins.bin_index(F.col("surface_azimuth_angle"), bins.AZIMUTH_BOUNDS).alias("azimuth_bin")).agg(F.count("*").alias("points"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(F.col(c)).alias(c) if c.startswith("intensity_") and c not in ("intensity_min", "intensity_max") else c for c in df.columns])


@query(_BEAMS + f", {_STATS} SELECT * FROM stats")
def signature_stats(spark, sf):
    return _rounded(bins.signature_stats(enriched(spark, sf, names=False, classes=False)))


def _bounds_sql(index: str, bounds, name: str) -> str:
    return ", ".join(f"list_extract([{', '.join(f'{float(b)!r}::DOUBLE' for b in bounds)}], {index} + {k}) AS {name}_bin_{s}" for k, s in ((0, "lower"), (1, "upper")))


_SIDES = {"sensor": ("lineitem", "l_returnflag"), "campaign": ("orders", "o_orderpriority")}
_NAMES = ", ".join(f"{k} AS (SELECT DISTINCT {c} AS id, '{k} ' || {c} AS name FROM {t})" for k, (t, c) in _SIDES.items())
_INFO = "info AS (SELECT s_suppkey AS feature_id, s_name AS feature_object_id, CASE WHEN s_suppkey % 3 <> 0 THEN r_name END AS feature_object_name, n_name AS feature_class_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


def entities_of(spark, sf, kind: str) -> DataFrame:
    table, column = _SIDES[kind]
    return _t(spark, sf, table).select(F.col(column).alias("id")).distinct().withColumn("name", F.concat(F.lit(f"{kind} "), "id"))


def feature_info(spark, sf) -> DataFrame:
    joined = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(F.col("s_suppkey").alias("feature_id"), F.col("s_name").alias("feature_object_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("r_name")).alias("feature_object_name"), F.col("n_name").alias("feature_class_name"))


_PCT = ", ".join("intensity_median" if p == 50 else f"intensity_p{p}" for p in bins.PERCENTILES)


@query(
    _BEAMS + f", {_STATS}, {_NAMES}, {_INFO} SELECT feature_object_id, feature_object_name, feature_class_name, sensor_id, sensor.name AS sensor_name, campaign_id, campaign.name AS campaign_name, "
    f"{_bounds_sql('range_bin', bins.RANGE_BOUNDS, 'spherical_range')}, {_bounds_sql('zenith_bin', bins.ZENITH_BOUNDS, 'surface_zenith_angle')}, {_bounds_sql('azimuth_bin', bins.AZIMUTH_BOUNDS, 'surface_azimuth_angle')}, "
    f"intensity_mean, intensity_stddev, intensity_min, {_PCT}, intensity_max, round(intensity_p75 - intensity_p25, 6) AS intensity_iqr, points_count::INTEGER AS points_count FROM stats JOIN sensor ON sensor.id = sensor_id JOIN campaign ON campaign.id = campaign_id JOIN info USING (feature_id)"
)
def signature_export(spark, sf):
    out = bins.exported(signature_stats(spark, sf), entities_of(spark, sf, "sensor"), entities_of(spark, sf, "campaign"), feature_info(spark, sf))
    return out.withColumn("intensity_iqr", _r(F.col("intensity_iqr")))


def _case_name(index: str, bounds, degrees: bool = False) -> str:
    return f"list_extract([{', '.join(repr(n) for n in bins.bin_names(bounds, degrees))}], {index})"


_LABEL = "'lidar_sensor_' || sensor_id || '_campaign_' || campaign_id || '_range_' || " + _case_name("range_bin", bins.RANGE_BOUNDS) + " || '_surface_zenith_angle_' || " + _case_name("zenith_bin", bins.ZENITH_BOUNDS, True) + " || '_surface_azimuth_angle_' || " + _case_name("azimuth_bin", bins.AZIMUTH_BOUNDS, True)


@query(
    _BEAMS + f", {_STATS}, labelled AS (SELECT *, {_LABEL} AS label FROM stats) "
    + " UNION ALL ".join(f"SELECT feature_id, 3 AS namespace_id, {3 if m == 'points_count' else 4} AS datatype_id, label || '_{m}' AS name, {'NULL::DOUBLE' if m == 'points_count' else m + '::DOUBLE'} AS val_float8, {'points_count::BIGINT' if m == 'points_count' else 'NULL::BIGINT'} AS val_int FROM labelled WHERE label IS NOT NULL AND {m} IS NOT NULL" for m in bins.METRICS)
)
def signature_properties(spark, sf):
    return bins.as_properties(signature_stats(spark, sf))


def _events(spark, sf):
    e = _t(spark, sf, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    poses = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", ns.alias("ts_ns"), V.point("value", F.col("event_id") % 100, F.col("event_id") % 7).alias("position"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(F.col("event_id") % 3 * 0.5).alias("z"), F.cos(F.col("event_id") % 3 * 0.5).alias("w")).alias("orientation"))
    return poses, e.where("event_type <> 'click'").select("user_id", ns.alias("ts_ns"), "event_id")


_POSES = "WITH e AS (SELECT *, epoch_us(ts) * 1000 AS ts_ns FROM events), p AS (SELECT user_id, ts_ns, value AS x, (event_id % 100)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z, event_id % 3 * 0.5::DOUBLE AS turn FROM e WHERE event_type = 'click'), q AS (SELECT user_id, ts_ns, event_id FROM e WHERE event_type <> 'click'), a AS (SELECT q.*, p.ts_ns AS pt, p.x AS px, p.y AS py, p.z AS pz, p.turn AS pturn FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.ts_ns >= p.ts_ns), b AS (SELECT a.*, p.ts_ns AS nt, p.x AS nx, p.y AS ny, p.z AS nz, p.turn AS nturn FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.ts_ns < p.ts_ns) "


@query(_POSES + "SELECT event_id, pt AS prev_ns, nt AS next_ns, px AS prev_x, nx AS next_x FROM b")
def pose_prev_next(spark, sf):
    n = asof.neighbours(*_events(spark, sf), "user_id", "ts_ns", ["position", "orientation"], tie="id")
    return n.select("event_id", F.col("prev.ts_ns").alias("prev_ns"), F.col("next.ts_ns").alias("next_ns"), F.col("prev.position.x").alias("prev_x"), F.col("next.position.x").alias("next_x"))


@query(_POSES + ", c AS (SELECT *, CASE WHEN pt IS NULL OR nt IS NULL OR pt = ts_ns THEN NULL ELSE (ts_ns - pt)::DOUBLE / (nt - pt)::DOUBLE END AS r FROM b) SELECT event_id, " + ", ".join(f"round(coalesce(p{k} + (n{k} - p{k}) * r, p{k}, n{k}), 6) AS {k}" for k in "xyz") + ", round(sin(coalesce(pturn + (nturn - pturn) * r, pturn, nturn)), 6) AS qz FROM c")
def pose_interpolated(spark, sf):
    n = asof.neighbours(*_events(spark, sf), "user_id", "ts_ns", ["position", "orientation"], tie="id")
    position, orientation = asof.interpolated("ts_ns")
    n = n.select("event_id", position.alias("p"), orientation.alias("q"))
    return n.select("event_id", *[_r(F.col(f"p.{c}")).alias(c) for c in "xyz"], _r(F.col("q.z")).alias("qz"))


def _vectors(spark, sf):
    e = _t(spark, sf, "embeddings")
    d = lambda i: F.col("embedding")[i].cast("double")
    return e.select("vec_id", V.point(d(0), d(1), d(2)).alias("a"), V.point(d(3), d(4), d(5)).alias("b"), F.struct(d(6).alias("x"), d(7).alias("y"), d(8).alias("z"), d(9).alias("w")).alias("q"))


_VEC = "WITH v AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {n}" for i, n in enumerate(("ax", "ay", "az", "ex", "ey", "ez", "qx", "qy", "qz", "qw"))) + " FROM embeddings) "


@query(_VEC + "SELECT vec_id, round(ay * ez - az * ey, 6) AS cx, round(az * ex - ax * ez, 6) AS cy, round(ax * ey - ay * ex, 6) AS cz, round(ax * ex + ay * ey + az * ez, 6) AS d, round(atan2(sqrt((ay * ez - az * ey) ** 2 + (az * ex - ax * ez) ** 2 + (ax * ey - ay * ex) ** 2), ax * ex + ay * ey + az * ez), 6) AS ang FROM v")
def cross_dot_angle(spark, sf):
    v = _vectors(spark, sf).select("vec_id", V.cross(F.col("a"), F.col("b")).alias("c"), V.dot(F.col("a"), F.col("b")).alias("d"), V.angle(F.col("a"), F.col("b")).alias("ang"))
    return v.select("vec_id", *[_r(F.col(f"c.{k}")).alias(f"c{k}") for k in "xyz"], _r(F.col("d")).alias("d"), _r(F.col("ang")).alias("ang"))


@query(_VEC + "SELECT vec_id, round(atan2(ay, ax), 6) AS azimuth, round(atan2(az, sqrt(ax * ax + ay * ay)), 6) AS elevation, round(sqrt(ax * ax + ay * ay + az * az), 6) AS range FROM v")
def spherical_coords(spark, sf):
    return _vectors(spark, sf).select("vec_id", V.spherical(F.col("a")).alias("s")).select("vec_id", *[_r(F.col(f"s.{k}")).alias(k) for k in ("azimuth", "elevation", "range")])


@query(_VEC + ", n AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS s FROM v), u AS (SELECT vec_id, ax, ay, az, qx / s AS x, qy / s AS y, qz / s AS z, qw / s AS w FROM n) SELECT vec_id, round((1 - 2 * (y * y + z * z)) * ax + 2 * (x * y - z * w) * ay + 2 * (x * z + y * w) * az, 6) AS rx, round(2 * (x * y + z * w) * ax + (1 - 2 * (x * x + z * z)) * ay + 2 * (y * z - x * w) * az, 6) AS ry, round(2 * (x * z - y * w) * ax + 2 * (y * z + x * w) * ay + (1 - 2 * (x * x + y * y)) * az, 6) AS rz FROM u")
def rotate_vectors(spark, sf):
    return _vectors(spark, sf).select("vec_id", V.rotate(F.col("a"), F.col("q")).alias("r")).select("vec_id", *[_r(F.col(f"r.{k}")).alias(f"r{k}") for k in "xyz"])


@query("WITH a AS (SELECT vec_id, label * 0.1::DOUBLE AS s, label * 0.1::DOUBLE + 0.3 + embedding[1]::DOUBLE * 0.1 AS e FROM embeddings) SELECT vec_id, round(sin(s + (e - s) * 0.25), 6) AS z, round(cos(s + (e - s) * 0.25), 6) AS w FROM a")
def slerp_pose(spark, sf):
    turn = lambda a: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(a).alias("z"), F.cos(a).alias("w"))
    s = F.col("label") * 0.1
    v = _t(spark, sf, "embeddings").select("vec_id", V.slerp(turn(s), turn(s + 0.3 + F.col("embedding")[0].cast("double") * 0.1), F.lit(0.25)).alias("q"))
    return v.select("vec_id", _r(F.col("q.z")).alias("z"), _r(F.col("q.w")).alias("w"))


def _quads(spark, sf):
    """Two parallel quads for each supplier."""
    s = _t(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"))
    x, y, z = F.col("s_suppkey") % 10 * 10.0, F.floor(F.col("s_suppkey") / 10) * 10.0, F.col("layer") * 0.3
    ring = F.array(*[V.point(x + a, y + b, z) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    q = s.select((F.col("s_suppkey") * 2 + F.col("layer")).alias("id"), ring.alias("exterior"), F.array().cast("array<array<struct<x:double,y:double,z:double>>>").alias("holes"))
    return q.withColumns({"normal": G.normal(F.col("exterior")), "centroid": G.centroid(F.col("exterior"))})


def _tilted(spark, sf):
    k = F.col("s_suppkey") % 3 / 2
    x, y = F.col("s_suppkey") % 10 * 10.0, F.floor(F.col("s_suppkey") / 10) * 10.0
    ring = F.array(*[V.point(x + a, y + b, (x + a) * k) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    q = _t(spark, sf, "supplier").select("s_suppkey", ring.alias("r"), x.alias("x"), y.alias("y"), (x * k).alias("z"))
    return q.select("s_suppkey", G.normal(F.col("r")).alias("n"), G.centroid(F.col("r")).alias("c"), V.point(F.col("x") + 0.5, F.col("y") + 0.25, F.col("z") + 5).alias("start"), "x", "y", "z")


_TILT = "WITH t AS (SELECT s_suppkey, (s_suppkey % 3)::DOUBLE / 2 AS k, (s_suppkey % 10) * 10.0::DOUBLE AS x, floor(s_suppkey / 10) * 10.0::DOUBLE AS y FROM supplier), u AS (SELECT *, sqrt(1 + k * k) AS m, x + 0.5 AS cx, y + 0.5 AS cy, (x + 0.5) * k AS cz, x + 0.5 AS sx, y + 0.25 AS sy, x * k + 5 AS sz FROM t) "


@query(_TILT + "SELECT s_suppkey, round(-k / m, 6) + 0.0 AS nx, 0.0::DOUBLE AS ny, round(1 / m, 6) AS nz, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM u")
def polygon_normals(spark, sf):
    return _tilted(spark, sf).select("s_suppkey", *[_r(F.col(f"n.{k}")).alias(f"n{k}") for k in "xyz"], *[_r(F.col(f"c.{k}")).alias(f"c{k}") for k in "xyz"])


@query(_TILT + ", w AS (SELECT *, cx - sx AS dx, cy - sy AS dy, cz - sz AS dz FROM u), a AS (SELECT *, acos(-(-k * dx + dz) / m / sqrt(dx * dx + dy * dy + dz * dz)) AS zen, (-k * (cx - sx) + (cz - sz)) / m AS h FROM w) SELECT s_suppkey, round(zen, 5) AS zenith, round((-k * (cx - sx) + (cz - sz)) / m / ((-k * dx + dz) / m / sqrt(dx * dx + dy * dy + dz * dz)), 5) AS t FROM a")
def zenith_line_plane(spark, sf):
    q = _tilted(spark, sf)
    z, t = G.zenith(F.col("n"), F.col("start"), F.col("c")), V.line_plane_parameter(F.col("start"), V.sub(F.col("c"), F.col("start")), F.col("c"), F.col("n"))
    return q.select("s_suppkey", _r(z, 5).alias("zenith"), _r(t, 5).alias("t"))


@query("WITH q AS (SELECT s_suppkey, (s_suppkey % 10) * 0.1::DOUBLE - 0.45 AS dx, (s_suppkey % 7) * 0.1::DOUBLE - 0.35 AS dy FROM supplier) SELECT s_suppkey, round(CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END, 5) AS azimuth FROM q")
def surface_azimuth(spark, sf):
    """On a horizontal quad the frame is the x and y axes; the line runs by (dx, dy) over it."""
    dx, dy = F.col("s_suppkey") % 10 * 0.1 - 0.45, F.col("s_suppkey") % 7 * 0.1 - 0.35
    a = G.azimuth(V.point(0, 0, 1), V.point(0, 0, 0), V.point(-dx, -dy, 5), V.point(0, 0, 0))
    return _t(spark, sf, "supplier").select("s_suppkey", _r(a, 5).alias("azimuth"))


@query(_VEC + ", s AS (SELECT *, sqrt((ex - ax) ** 2 + (ey - ay) ** 2 + (ez - az) ** 2) AS len FROM v) SELECT vec_id, round(len, 6) AS beam_length, " + ", ".join(f"round(e{k} {o} (e{k} - a{k}) / len * 0.5, 6) AS {n}{k}" for n, o in (("s", "-"), ("e", "+")) for k in "xyz") + " FROM s")
def uncertainty_segments(spark, sf):
    v = _vectors(spark, sf).select("vec_id", G.length(F.col("a"), F.col("b")).alias("len"), G.uncertainty_segment(F.col("a"), F.col("b"), 1.0).alias("s"))
    return v.select("vec_id", _r(F.col("len")).alias("beam_length"), *[_r(F.col(f"s.{p}.{k}")).alias(f"{n}{k}") for n, p in (("s", "p0"), ("e", "p1")) for k in "xyz"])


@query("SELECT vec_id, generate_subscripts(embedding, 1) AS point_index, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def unpack_points(spark, sf):
    return payload.unpacked(_t(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("value", _r(F.col("value").cast("double")))


@query("SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS weighted FROM embeddings")
def pack_points(spark, sf):
    points = payload.unpacked(_t(spark, sf, "embeddings"), "vec_id", "embedding")
    p = payload.packed(points, "vec_id")
    return p.select("vec_id", F.size("values").alias("n"), _r(F.aggregate(F.transform("values", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("weighted"))


@query("WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.vec_id, round(sum(a.v * b.v), 4) AS product, count(*) AS points FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY ALL")
def positional_join(spark, sf):
    u = payload.unpacked(_t(spark, sf, "embeddings"), "vec_id", "embedding")
    shifted = u.select((F.col("vec_id") - 1).alias("vec_id"), "point_index", F.col("value").alias("other"))
    return payload.positional(u, shifted, "vec_id").groupBy("vec_id").agg(_r(F.sum(F.col("value").cast("double") * F.col("other").cast("double")), 4).alias("product"), F.count("*").alias("points"))


def _hits(spark, sf):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    least = _t(spark, sf, "lineitem").groupBy(*key).agg(F.min(F.struct("l_quantity", "l_tax", "l_discount")).alias("m"))
    x, y, z = F.col("l_suppkey") % 10 * 10.0 + F.col("m.l_tax") * 20 - 0.31, F.floor(F.col("l_suppkey") / 10) * 10.0 + F.col("m.l_discount") * 15 - 0.21, (F.col("m.l_quantity") - 25) / 40
    return least.select(*key, V.point(x, y, z).alias("position")), key


_HITS = "WITH pt AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax * 20 - 0.31 AS x, l_discount * 15 - 0.21 AS y, (l_quantity - 25) / 40 AS z FROM lineitem ORDER BY l_quantity, l_tax, l_discount), c AS (SELECT pt.*, l_suppkey * 2 + layer AS polygon_id, greatest(-x, x - 1, 0) AS dx, greatest(-y, y - 1, 0) AS dy, z - layer * 0.3::DOUBLE AS h FROM pt, (SELECT unnest([0, 1]) AS layer)) "


@query(_HITS + ", d AS (SELECT *, sqrt(dx * dx + dy * dy + h * h)::FLOAT AS dist FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY dist, polygon_id) AS n FROM d WHERE dist <= 0.5::FLOAT) SELECT pt.l_orderkey, pt.l_linenumber, pt.l_partkey, pt.l_suppkey, polygon_id, round(dist::DOUBLE, 4) AS surface_distance FROM pt LEFT JOIN b ON b.l_orderkey = pt.l_orderkey AND b.l_linenumber = pt.l_linenumber AND b.l_partkey = pt.l_partkey AND b.l_suppkey = pt.l_suppkey AND n = 1")
def assoc_point_top1(spark, sf):
    points, key = _hits(spark, sf)
    return associate.nearest_surface(points, _quads(spark, sf), key).select(*key, "polygon_id", _r(F.col("surface_distance").cast("double"), 4).alias("surface_distance"))


@query(_HITS + ", d AS (SELECT *, sqrt(dx * dx + dy * dy + greatest(abs(h) - 0.5, 0) ** 2)::FLOAT AS dist, h::FLOAT AS t FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY t, dist, polygon_id) AS n FROM d WHERE dist <= 0.05::FLOAT AND abs(t) <= 0.5) SELECT pt.l_orderkey, pt.l_linenumber, pt.l_partkey, pt.l_suppkey, polygon_id, round(t::DOUBLE, 4) AS t FROM pt LEFT JOIN b ON b.l_orderkey = pt.l_orderkey AND b.l_linenumber = pt.l_linenumber AND b.l_partkey = pt.l_partkey AND b.l_suppkey = pt.l_suppkey AND n = 1")
def assoc_beam_top1(spark, sf):
    points, key = _hits(spark, sf)
    beams = points.withColumn("sensor_position", V.add(F.col("position"), V.point(0, 0, 5)))
    beams = beams.withColumn("s", G.uncertainty_segment(F.col("sensor_position"), F.col("position"), 1.0)).select("*", "s.p0", "s.p1").drop("s")
    return associate.first_hit(beams, _quads(spark, sf), key).select(*key, "polygon_id", _r(F.col("t").cast("double"), 4).alias("t"))


@query("SELECT event_type AS name, count(DISTINCT user_id) AS cells, count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events) AS is_consistent FROM events GROUP BY ALL")
def attribute_consistency(spark, sf):
    e = _t(spark, sf, "events")
    total = e.agg(F.count_distinct("user_id").alias("total"))
    return e.groupBy(F.col("event_type").alias("name")).agg(F.count_distinct("user_id").alias("cells")).crossJoin(F.broadcast(total)).select("name", "cells", (F.col("cells") == F.col("total")).alias("is_consistent"))


@query("WITH c AS (SELECT user_id, count(*) AS point_count, min(value) AS lo, max(value) AS hi, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM events GROUP BY ALL) SELECT user_id, point_count, CAST(round(t0 / 1e6) AS BIGINT) AS start_epoch, CAST(round((t1 - t0) / 1e6) AS BIGINT) AS duration, round((hi - lo) ** 3, 3) AS volume, round(point_count / nullif((hi - lo) ** 3, 0), 9) AS points_per_m3, lo AS xmin, hi AS xmax FROM c")
def cell_view(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    c = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("point_count"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(us).alias("t0"), F.max(us).alias("t1"))
    volume = F.pow(F.col("hi") - F.col("lo"), 3)
    return c.select("user_id", "point_count", F.round(F.col("t0") / 1e6).cast("long").alias("start_epoch"), F.round((F.col("t1") - F.col("t0")) / 1e6).cast("long").alias("duration"), _r(volume, 3).alias("volume"), _r(F.try_divide(F.col("point_count"), F.nullif(volume, F.lit(0.0))), 9).alias("points_per_m3"), F.col("lo").alias("xmin"), F.col("hi").alias("xmax"))


_DEPTH, _LEAF = 6, 500
_OCTREE = (
    "WITH pt AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) l_suppkey % 10 * 10.0::DOUBLE + l_tax * 20 - 0.31 AS x, floor(l_suppkey / 10) * 10.0::DOUBLE + l_discount * 15 - 0.21 AS y, (l_quantity - 25) / 40 AS z FROM lineitem ORDER BY l_quantity, l_tax, l_discount), "
    "r AS (SELECT min(x) AS xlo, min(y) AS ylo, min(z) AS zlo, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM pt), "
    f"d AS (SELECT pt.*, " + ", ".join(f"least(floor(({c} - {c}lo) / CASE WHEN side > 0 THEN side ELSE 1.0 END * {1 << _DEPTH})::INTEGER, {(1 << _DEPTH) - 1}) AS d{c}" for c in "xyz") + " FROM pt, r), "
    + "o AS (" + " UNION ALL ".join(f"SELECT x, y, z, dx, dy, dz, {k} AS level, dx >> {_DEPTH - k} AS cell_x, dy >> {_DEPTH - k} AS cell_y, dz >> {_DEPTH - k} AS cell_z FROM d" for k in range(_DEPTH + 1)) + "), "
    + f"n AS (SELECT *, count(*) OVER (PARTITION BY level, cell_x, cell_y, cell_z) AS n FROM o), s AS (SELECT *, min(CASE WHEN n <= {_LEAF} OR level = {_DEPTH} THEN level END) OVER (PARTITION BY dx, dy, dz) AS leaf FROM n) "
)


@query(_OCTREE + "SELECT level, cell_x, cell_y, cell_z, count(*) AS points, " + ", ".join(f"round({f}({c}), 6) + 0.0 AS {c}{f}" for c in "xyz" for f in ("min", "max")) + " FROM s WHERE level = leaf GROUP BY ALL")
def octree_cells(spark, sf):
    points, key = _hits(spark, sf)
    flat = points.select(*key, "position.*")
    return octree.octants(flat, max_points=_LEAF, depth=_DEPTH).groupBy("level", "cell_x", "cell_y", "cell_z").agg(F.count("*").alias("points"), *[_r(f(c)).alias(f"{c}{s}") for c in "xyz" for s, f in (("min", F.min), ("max", F.max))])


@query("SELECT user_id, count(*) AS poses, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS line FROM events WHERE event_type = 'click' GROUP BY ALL")
def trajectory_lines(spark, sf):
    e = _t(spark, sf, "events").where("event_type = 'click'")
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id")))
    return e.groupBy("user_id").agg(F.count("*").alias("poses"), F.array_join(F.transform(ordered, lambda r: r["event_id"].cast("string")), ",").alias("line"))


def _boxes(spark, sf):
    x, y = F.col("s_suppkey") % 10 * 10.0, F.floor(F.col("s_suppkey") / 10) * 10.0
    box = F.struct(x.alias("xmin"), y.alias("ymin"), F.lit(0.0).alias("zmin"), (x + 1).alias("xmax"), (y + 1).alias("ymax"), F.lit(0.3).alias("zmax"))
    return _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 17 != 0, box).alias("envelope"))


_BOX = "WITH b AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 17 <> 0 THEN (s_suppkey % 10) * 10.0 END AS x, CASE WHEN s_suppkey % 17 <> 0 THEN floor(s_suppkey / 10) * 10.0 END AS y FROM supplier) "


@query(_BOX + "SELECT s_suppkey FROM b WHERE x + 1 >= 20 AND y + 1 >= 0")
def bbox_filter(spark, sf):
    return _boxes(spark, sf).where(entities.box_overlap(F.col("envelope"), lo=(20, 0, -1))).select("s_suppkey")


@query(_BOX + "SELECT s_suppkey FROM b WHERE x IS NULL OR (x + 1 >= 5 AND y + 1 >= 5 AND x <= 45 AND y <= 50)")
def crop_keep(spark, sf):
    return entities.cropped(_boxes(spark, sf), (5, 5, -1), (45, 50, 1)).select("s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def exclude_class(spark, sf):
    gone = _t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return _t(spark, sf, "supplier").join(gone, "s_nationkey", "left_anti").select("s_suppkey")


@query("WITH m AS (SELECT event_type, epoch_us(ts) * 1000 AS ns, min(epoch_us(ts) * 1000) OVER () AS a, max(epoch_us(ts) * 1000) OVER () AS b FROM events) SELECT event_type AS topic, least((ns - a) // 3600000000000, greatest(1, CAST(ceil((b - a) / 3600000000000) AS BIGINT)) - 1)::BIGINT AS slice, count(*) AS messages FROM m GROUP BY ALL")
def time_slices(spark, sf):
    e = _t(spark, sf, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"))
    span = e.agg(F.min("ns").alias("first"), F.max("ns").alias("last"))
    sliced = e.crossJoin(F.broadcast(span)).select(F.col("event_type").alias("topic"), slice_index(F.col("ns"), F.col("first"), F.col("last"), 3600 * 10**9).cast("long").alias("slice"))  # one row
    return sliced.groupBy("topic", "slice").agg(F.count("*").alias("messages"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY o_orderpriority) AS id, o_orderpriority AS name FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def upsert_entities(spark, sf):
    have = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return entities.upserted(have, _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("name")), ["name"])


@query("SELECT p_partkey, p_type FROM part WHERE NOT p_type LIKE 'S%' AND NOT (p_size <= 10 AND p_brand IN ('Brand#11', 'Brand#12'))")
def clean_patterns(spark, sf):
    p = entities.without_pattern(_t(spark, sf, "part").withColumn("name", F.col("p_type")), "S%")
    return p.where(~((F.col("p_size") <= 10) & F.col("p_brand").isin("Brand#11", "Brand#12"))).select("p_partkey", "p_type")


@query("SELECT s_suppkey AS id, s_name AS feature_object_id, n_name AS feature_class_name, r_name AS feature_object_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def feature_list(spark, sf):
    t = lambda n: _t(spark, sf, n)
    j = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return j.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("feature_object_id"), F.col("n_name").alias("feature_class_name"), F.col("r_name").alias("feature_object_name"))


@query("SELECT s_suppkey AS id, 'supplier' AS kind, s_name AS name FROM supplier UNION ALL SELECT n_nationkey, 'nation', n_name FROM nation ORDER BY kind, id")
def union_export_sorted(spark, sf):
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    return s.unionByName(_t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))).orderBy("kind", "id")


@query("SELECT s_suppkey, 'platform without nation' AS violation FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT s_suppkey, 'negative balance' FROM supplier WHERE s_acctbal < 0")
def constraint_violations(spark, sf):
    return entities.violations(_t(spark, sf, "supplier"), {"platform without nation": F.col("s_nationkey") >= 5, "negative balance": F.col("s_acctbal") >= 0}).select("s_suppkey", "violation")
