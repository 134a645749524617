"""Registered queries of composed operators: sensor views, association with dispatch, statistics, cells, sources, cleaning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.functions import geometry as G
from beamlake.functions import sql as session_functions
from beamlake.functions import text as T
from beamlake.functions import vector as V
from beamlake.operators import associate, bins, entities, features, kernel, numbering, octree, payload, statistics, views
from beamlake.plans.catalog import _BEAMS, _BOX, _HITS, _INFO, _LEAF, _OCTREE, _POSES, _STATS, _VEC, _boxes, _hits, _quads, _r, _t, _vectors, enriched, feature_info, query, signature_stats
from beamlake.sources import messages

# ---------------------------------------------------------------- sensor views
_CLICKS = "e.event_type = 'click'"
#: The pose of b's rows: between prev and next linear, outside the nearest; then the beam to (value, user_id, 10).
_POSED = ", c AS (SELECT *, CASE WHEN pt IS NULL OR nt IS NULL OR pt = ts_ns THEN NULL ELSE (ts_ns - pt)::DOUBLE / (nt - pt)::DOUBLE END AS r FROM b), s AS (SELECT event_id, " + ", ".join(f"coalesce(p{k} + (n{k} - p{k}) * r, p{k}, n{k}) AS s{k}" for k in "xyz") + ", 2 * coalesce(pturn + (nturn - pturn) * r, pturn, nturn) AS turn FROM c)"
_BEAM = _POSED + ", g AS (SELECT s.*, events.value + 1 - sx AS dx, events.user_id - sy AS dy, 10 - sz AS dz, events.value + 1 AS x, events.user_id::DOUBLE AS y, 10.0::DOUBLE AS z FROM s JOIN events USING (event_id)), h AS (SELECT *, dx * cos(turn) + dy * sin(turn) AS lx, dy * cos(turn) - dx * sin(turn) AS ly, sqrt(dx * dx + dy * dy + dz * dz) AS range FROM g)"


def _timed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, trajectories, poses): click events are poses of the user's trajectory, other events points."""
    e = _t(spark, sf, "events").withColumn("ts_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    half = F.col("event_id") % 3 * 0.5
    poses = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("trajectory_id"), "ts_ns", F.lit(None).cast("int").alias("sequence_index"), V.point("value", F.col("event_id") % 100, F.col("event_id") % 7).alias("position"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(half).alias("z"), F.cos(half).alias("w")).alias("orientation"))
    lines = e.select(F.col("user_id").alias("id")).distinct().select("id", F.col("id").alias("recording_id"), F.lit("timed").alias("domain"), F.lit("linear").alias("interpolation_type"))
    points = e.where("event_type <> 'click'").select("event_id", F.col("user_id").alias("recording_id"), "ts_ns", V.point(F.col("value") + 1, F.col("user_id"), 10).alias("position"))
    return points, lines, poses


@query(_POSES + _BEAM + " SELECT event_id, " + ", ".join(f"round(s{k}, 5) AS s{k}, round(d{k}, 5) AS d{k}" for k in "xyz") + ", round(atan2(dz, sqrt(lx * lx + ly * ly)), 5) AS elevation, round(range, 5) AS range, " + ", ".join(f"round({k} - d{k} / range * 0.5, 5) AS p0{k}, round({k} + d{k} / range * 0.5, 5) AS p1{k}" for k in "xyz") + " FROM h")
def sensor_views(spark, sf):
    """Poses, directions, spherical coordinates and uncertainty segments in one job."""
    v = views.sensor_views(*_timed(spark, sf))
    pick = [_r(F.col(f"{c}.{k}"), 5).alias(f"{n}{k}") for n, c in (("s", "sensor_position"), ("d", "direction"), ("p0", "p0"), ("p1", "p1")) for k in "xyz"]
    return v.select("event_id", *pick, _r(F.col("elevation_angle"), 5).alias("elevation"), _r(F.col("spherical_range"), 5).alias("range"))


@query(_POSES + _BEAM + " SELECT event_id, round(cos(atan2(ly, lx)), 4) + 0.0 AS c, round(sin(atan2(ly, lx)), 4) + 0.0 AS s FROM h WHERE sqrt(lx * lx + ly * ly) > 0.01")
def beam_azimuth(spark, sf):
    """The azimuth in the sensor's frame, as cosine and sine, so that the cut at half a turn does not matter."""
    v = views.sensor_views(*_timed(spark, sf)).where(F.sqrt(F.pow("direction.x", 2) + F.pow("direction.y", 2)) > 0.01)
    return v.select("event_id", _r(F.cos("azimuth_angle"), 4).alias("c"), _r(F.sin("azimuth_angle"), 4).alias("s"))


@query(_POSES + "SELECT event_id, coalesce(px, nx) AS x, round(coalesce(pz, nz), 6) AS z FROM b")
def step_pose(spark, sf):
    points, lines, poses = _timed(spark, sf)
    v = views.sensor_poses(points, lines.withColumn("interpolation_type", F.lit("step")), poses)
    return v.select("event_id", F.col("sensor_position.x").alias("x"), _r(F.col("sensor_position.z")).alias("z"))


@query("WITH p AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN event_id % 40 END AS i FROM events), l AS (SELECT user_id, arg_max(value, (coalesce(i, 1000), event_id)) AS x FROM p GROUP BY ALL) SELECT event_id, x FROM events JOIN l USING (user_id) WHERE event_type = 'view' OR event_type = 'purchase'")
def sequence_pose(spark, sf):
    """Trajectories by sequence: the last pose serves all times; a pose without an index is the last of all."""
    e = _t(spark, sf, "events")
    poses = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("trajectory_id"), F.lit(None).cast("long").alias("ts_ns"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 40).cast("int").alias("sequence_index"), V.point("value", 0, 0).alias("position"), F.lit(None).cast("struct<x:double,y:double,z:double,w:double>").alias("orientation"))
    lines = e.select(F.col("user_id").alias("id")).distinct().select("id", F.col("id").alias("recording_id"), F.lit("sequence").alias("domain"), F.lit("step").alias("interpolation_type"))
    points = e.where("event_type in ('view', 'purchase')").select("event_id", F.col("user_id").alias("recording_id"), F.lit(5).cast("long").alias("ts_ns"))
    return views.sensor_poses(points, lines, poses).select("event_id", F.col("sensor_position.x").alias("x"))


# ---------------------------------------------------------------- association
_CELLED = ", k AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS point_index, sqrt(dx * dx + dy * dy + h * h)::FLOAT AS near, sqrt(dx * dx + dy * dy + greatest(abs(h) - 0.5, 0) ** 2)::FLOAT AS line, h::FLOAT AS t FROM c), cells AS (SELECT DISTINCT l_suppkey AS cell_id, point_index FROM k)"
_EVEN = "SELECT l_suppkey AS cell_id, point_index, polygon_id, near, line, t, row_number() OVER (PARTITION BY l_suppkey, point_index ORDER BY t, line, polygon_id) AS n FROM k WHERE l_suppkey % 2 = 0 AND line <= 0.05::FLOAT AND abs(t) <= 0.5"
_ODD = "SELECT l_suppkey AS cell_id, point_index, polygon_id, near, NULL::FLOAT AS line, NULL::FLOAT AS t, row_number() OVER (PARTITION BY l_suppkey, point_index ORDER BY near, polygon_id) AS n FROM k WHERE l_suppkey % 2 = 1 AND near <= 0.5::FLOAT"


def _celled(spark, sf) -> DataFrame:
    """Points in cells by supplier; cells of even suppliers have beams from straight above."""
    points, _ = _hits(spark, sf)
    index = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    even = F.col("l_suppkey") % 2 == 0
    p = points.select(F.col("l_suppkey").alias("cell_id"), index.alias("point_index"), "position", F.when(even, V.add(F.col("position"), V.point(0, 0, 5))).alias("sensor_position"))
    q = F.lit(None).cast("struct<x:double,y:double,z:double,w:double>").alias("sensor_orientation")
    return views.beams(p.select("*", q))


def _associated(spark, sf, prefilter: str = "none") -> DataFrame:
    return associate.associate(_celled(spark, sf), _quads(spark, sf), "cell_id", "point_index", prefilter=prefilter)


@query(_HITS + _CELLED + f", u AS ({_EVEN} UNION ALL {_ODD}) SELECT cells.cell_id, cells.point_index, polygon_id, round(near::DOUBLE, 4) AS surface_distance, round(line::DOUBLE, 4) AS beam_distance, round(t::DOUBLE, 4) AS t FROM cells LEFT JOIN u ON u.cell_id = cells.cell_id AND u.point_index = cells.point_index AND n = 1")
def assoc_dispatch(spark, sf):
    """Cells with beams by first hit, the others by nearest surface, all points kept."""
    d = lambda c: _r(F.col(c).cast("double"), 4).alias(c)
    return _associated(spark, sf).select("cell_id", "point_index", "polygon_id", d("surface_distance"), d("beam_distance"), d("t"))


@query(_HITS + _CELLED + f", u AS ({_EVEN} UNION ALL {_ODD}) SELECT cells.cell_id, count(*) AS points, string_agg(coalesce(polygon_id::VARCHAR, '-'), ',' ORDER BY cells.point_index) AS polygons FROM cells LEFT JOIN u ON u.cell_id = cells.cell_id AND u.point_index = cells.point_index AND n = 1 GROUP BY ALL")
def assoc_packed(spark, sf):
    """The measures of a cell as arrays in point order, nulls included."""
    arrays = associate.packed_measures(_associated(spark, sf), "cell_id", "point_index")
    return arrays.select("cell_id", F.size("polygon_id").cast("long").alias("points"), F.array_join(F.transform("polygon_id", lambda p: F.coalesce(p.cast("string"), F.lit("-"))), ",").alias("polygons"))


@query(
    _HITS + ", box AS (SELECT l_suppkey, min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi, min(z) AS zlo, max(z) AS zhi FROM pt WHERE z > -0.19 AND z < 0.19 GROUP BY ALL), "
    "d AS (SELECT c.*, sqrt(dx * dx + dy * dy + h * h)::FLOAT AS dist FROM c JOIN box USING (l_suppkey) WHERE c.z > -0.19 AND c.z < 0.19 AND xlo <= 1 AND xhi >= 0 AND ylo <= 1 AND yhi >= 0 AND zlo <= (polygon_id % 2) * 0.3 AND zhi >= (polygon_id % 2) * 0.3), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY dist, polygon_id) AS n FROM d WHERE dist <= 0.5::FLOAT) SELECT pt.l_orderkey, pt.l_linenumber, pt.l_partkey, pt.l_suppkey, polygon_id FROM pt LEFT JOIN b ON b.l_orderkey = pt.l_orderkey AND b.l_linenumber = pt.l_linenumber AND b.l_partkey = pt.l_partkey AND b.l_suppkey = pt.l_suppkey AND n = 1 WHERE pt.z > -0.19 AND pt.z < 0.19"
)
def assoc_prefilter(spark, sf):
    """Only surfaces that meet the box of the cell's points: the upper quads are within reach of low points, but outside their box."""
    points, key = _hits(spark, sf)
    low = points.where("position.z > -0.19 and position.z < 0.19")
    return associate.nearest_surface(low, _quads(spark, sf), key, prefilter="envelope", cell="l_suppkey").select(*key, "polygon_id")


@query(_HITS + ", d AS (SELECT *, sqrt(dx * dx + dy * dy + h * h)::FLOAT AS dist FROM c) SELECT count(*) AS candidates, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS associated FROM d WHERE dist <= 0.5::FLOAT")
def assoc_candidate_count(spark, sf):
    points, _ = _hits(spark, sf)
    return associate.candidate_count(points.select(F.col("position").alias("p0"), F.col("position").alias("p1")), _quads(spark, sf), 0.5)


@query("WITH b AS (SELECT s_suppkey, (s_suppkey % 7) / 5.0::DOUBLE - 0.3 AS x, (s_suppkey % 11) / 8.0::DOUBLE - 0.2 AS z FROM supplier) SELECT s_suppkey, x <= 1 AND x + 0.2 >= 0 AND z <= 0.5 AND z + 0.2 >= 0.5 AND NOT (x > 0.25 AND x + 0.2 < 0.75) AS meets FROM b")
def polygon_meets_box(spark, sf):
    """Boxes of side 0.2 in the middle of a square with a square hole: inside the hole there is nothing to meet."""
    square = lambda lo, hi: F.array(*[V.point(a, b, 0.5) for a, b in ((lo, lo), (hi, lo), (hi, hi), (lo, hi))])
    x, z = F.col("s_suppkey") % 7 / 5 - 0.3, F.col("s_suppkey") % 11 / 8 - 0.2
    box = F.struct(x.alias("xmin"), F.lit(0.4).alias("ymin"), z.alias("zmin"), (x + 0.2).alias("xmax"), F.lit(0.6).alias("ymax"), (z + 0.2).alias("zmax"))
    s = _t(spark, sf, "supplier").select("s_suppkey", box.alias("box"), G.edges(square(0, 1), F.array(square(0.25, 0.75))).alias("edges"), V.point(0, 0, 1).alias("n"))
    return s.select("s_suppkey", kernel.polygon_meets_box(F.col("box"), F.col("edges"), F.col("n")).alias("meets"))


@query("SELECT s_suppkey * 2 + layer AS polygon_id, 0.0::DOUBLE AS nx, 1.0::DOUBLE AS nz, round((s_suppkey % 10) * 10 + 0.5::DOUBLE, 6) AS cx, round(layer * 0.3::DOUBLE, 6) AS cz FROM supplier, (SELECT unnest([0, 1]) AS layer) WHERE s_suppkey % 4 <> 3")
def exploded_surfaces(spark, sf):
    """Polygons of multi-geometries with normal and centroid; plain polygons are left out; ids run on by geometry and place."""
    q = _quads(spark, sf)
    parts = F.array_sort(F.collect_list(F.struct("id", F.struct("exterior", "holes").alias("polygon"))))
    kind = F.when(F.col("feature_id") % 4 == 3, "ST_Polygon").when(F.col("feature_id") % 4 == 1, "ST_MultiPolygon").otherwise("ST_PolyhedralSurface")
    g = q.groupBy(F.floor(F.col("id") / 2).alias("feature_id")).agg(parts.alias("p")).select(F.col("feature_id").alias("id"), "feature_id", kind.alias("geom_type"), F.transform("p", lambda r: r["polygon"]).alias("polygons"))
    s = features.exploded_surfaces(g)
    layer = F.round(F.col("centroid.z") / 0.3).cast("long")
    return s.select((F.col("feature_id") * 2 + layer).alias("polygon_id"), _r(F.col("normal.x")).alias("nx"), _r(F.col("normal.z")).alias("nz"), _r(F.col("centroid.x")).alias("cx"), _r(F.col("centroid.z")).alias("cz"))


# ---------------------------------------------------------------- statistics and signatures
_COUNTED = "count(*) AS points, count(feature_object_id) AS associated, count(DISTINCT feature_object_id) AS features"
_FIELDS = {"sensor_id": "VARCHAR", "campaign_id": "VARCHAR", "range_bin": "BIGINT", "feature_class_name": "VARCHAR", "feature_object_name": "VARCHAR"}
_USED = {"overview": "true", "sensor": "true", "campaign": "true", "campaign_range": "range_bin IS NOT NULL"}


@query(
    _BEAMS + ", f AS (SELECT sensor_id, campaign_id, CAST(floor(spherical_range / 15.0) AS BIGINT) AS range_bin, feature_class_name, CASE WHEN feature_class_name IS NOT NULL THEN coalesce(feature_object_name, '') END AS feature_object_name, feature_object_id FROM beams) "
    + " UNION ALL ".join(f"SELECT '{level}' AS level, " + ", ".join(f"{c if c in by else f'NULL::{k}'} AS {c}" for c, k in _FIELDS.items()) + f", {_COUNTED} FROM f WHERE {_USED.get(level, 'feature_class_name IS NOT NULL')} GROUP BY {', '.join(by) or '()'}" for level, by in statistics.LEVELS.items())
)
def statistics_counts(spark, sf):
    """All counts of the statistics document in one aggregation."""
    return statistics.sensor_counts(enriched(spark, sf))


@query("SELECT n_name AS feature_class_name, CASE WHEN s_suppkey IS NOT NULL THEN CASE WHEN s_suppkey % 3 <> 0 THEN r_name ELSE '' END END AS feature_object_name, count(s_suppkey) AS features FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey > 3) ON s_nationkey = n_nationkey GROUP BY ALL")
def city_model_counts(spark, sf):
    """Classes without features stay."""
    classes = _t(spark, sf, "nation").select(F.col("n_name").alias("feature_class_name"))
    large = _t(spark, sf, "supplier").where("s_nationkey > 3").select(F.col("s_suppkey").alias("feature_id"))
    return statistics.model_counts(classes, feature_info(spark, sf).join(large, "feature_id", "left_semi"))


@query(_BEAMS + f", {_STATS} SELECT dense_rank() OVER (ORDER BY feature_id, sensor_id, campaign_id) AS signature_id, range_bin, zenith_bin, azimuth_bin, points_count FROM stats")
def signature_tables(spark, sf):
    """Entries with the ids of their signatures, which are ranks of the key."""
    ids, entries = bins.signature_tables(signature_stats(spark, sf))
    return entries.join(ids.select(F.col("id").alias("signature_id")), "signature_id").select("signature_id", "range_bin", "zenith_bin", "azimuth_bin", "points_count")


# ---------------------------------------------------------------- cells, payload, rows
@query(
    _OCTREE + ", c AS (SELECT level, cell_x AS x, cell_y AS y, cell_z AS z, count(*) AS point_count, min(s.x) AS px FROM s WHERE level = leaf GROUP BY ALL) SELECT row_number() OVER (ORDER BY level, c.x, c.y, c.z) AS id, level, c.x, c.y, c.z, point_count, round(px, 6) + 0.0 AS point_xmin, "
    "round(xlo + c.x * side / (1 << level), 6) + 0.0 AS cell_xmin, round(zlo + (c.z + 1) * side / (1 << level), 6) + 0.0 AS cell_zmax, true AS no_sensor FROM c, r"
)
def cell_rows(spark, sf):
    """Cells as the import writes them: octants in order, their boxes and those of their points."""
    points, _ = _hits(spark, sf)
    flat = points.select(F.lit(1).alias("point_cloud_id"), "position.*", F.lit(0).cast("long").alias("ts_ns"), F.lit(None).cast("struct<x:double,y:double,z:double>").alias("sensor_position"))
    c = octree.cells(octree.octants(flat, _LEAF, 6, by=["point_cloud_id"]), octree.roots(flat, ["point_cloud_id"]))
    return c.select("id", "level", "x", "y", "z", "point_count", _r(F.col("point_envelope.xmin")).alias("point_xmin"), _r(F.col("cell_envelope.xmin")).alias("cell_xmin"), _r(F.col("cell_envelope.zmax")).alias("cell_zmax"), F.col("sensor_envelope").isNull().alias("no_sensor"))


@query(
    "WITH c AS (SELECT user_id AS id, user_id % 5 AS point_cloud_id, count(*) AS point_count, min(value) AS x0, max(value) AS x1, min(event_id % 100)::DOUBLE AS y0, max(event_id % 100)::DOUBLE AS y1, min(event_id % 7)::DOUBLE AS z0, max(event_id % 7)::DOUBLE AS z1, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM events GROUP BY ALL), v AS (SELECT *, (x1 - x0) * (y1 - y0) * (z1 - z0) AS volume FROM c) "
    "SELECT id, 'Name: ' || coalesce(CASE WHEN point_cloud_id <> 2 THEN 'rec ' || (point_cloud_id // 2) END, 'Unknown') || ', Octant: level=3,x=' || (id % 4) || ',y=1,z=2' AS cell_name, point_cloud_id, CAST(round(t0 / 1e6) AS INTEGER) AS start_date_timestamp, CAST(round(t1 / 1e6 - t0 / 1e6) AS INTEGER) AS duration, round(volume, 3) AS volume, point_count, round(point_count / nullif(volume, 0), 9) AS density, x0 AS x_min, y1 AS y_max, z1 AS z_max FROM v"
)
def cell_overview(spark, sf):
    """The view of cells with their recording: name, whole seconds, volume over all axes, density."""
    e = _t(spark, sf, "events").select("user_id", "ts", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), (F.col("event_id") % 7).cast("double").alias("z"))
    box = F.struct(*[f(c).alias(f"{c}{s}") for s, f in (("min", F.min), ("max", F.max)) for c in "xyz"])
    cells = e.groupBy(F.col("user_id").alias("id")).agg(box.alias("cell_envelope"), F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.count("*").alias("point_count"))
    cells = cells.select("*", (F.col("id") % 5).alias("point_cloud_id"), F.lit(3).alias("level"), (F.col("id") % 4).alias("x"), F.lit(1).alias("y"), F.lit(2).alias("z"), F.col("cell_envelope").alias("point_envelope"))
    clouds = spark.range(5).select("id", F.col("id").alias("recording_id"))
    recordings = spark.range(5).select("id", F.when(F.col("id") != 2, F.concat(F.lit("rec "), F.floor(F.col("id") / 2).cast("string"))).alias("name"))
    v = views.cell_view(cells, clouds, recordings)
    return v.select("id", "cell_name", "point_cloud_id", "start_date_timestamp", "duration", _r(F.col("volume"), 3).alias("volume"), "point_count", _r(F.col("points_per_cubic_meter"), 9).alias("density"), "x_min", "y_max", "z_max")


@query("SELECT user_id AS id, 'type ' || (user_id % 3) AS sensor_name, CASE WHEN user_id % 4 <> 0 THEN 'platform ' || (user_id % 4) END AS platform_name, string_agg(value::DECIMAL(18,2)::VARCHAR, ',' ORDER BY ts, event_id) AS line FROM events WHERE event_type = 'click' GROUP BY ALL")
def trajectory_overview(spark, sf):
    """Lines of poses in order, with the names of sensor and platform where there are any."""
    _, lines, poses = _timed(spark, sf)
    recordings = lines.select("id", (F.col("id") % 3).alias("sensor_id"), (F.col("id") % 4).alias("platform_id"))
    sensors = spark.range(3).select("id", F.concat(F.lit("type "), "id").alias("name"))
    platforms = spark.range(1, 4).select("id", F.concat(F.lit("platform "), "id").alias("name"))
    t = views.trajectory_lines(lines, poses, recordings, sensors, platforms)
    return t.select("id", "sensor_name", "platform_name", F.array_join(F.transform("line", lambda p: p["x"].cast("decimal(18,2)").cast("string")), ",").alias("line"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS id FROM events")
def point_numbers(spark, sf):
    """Ids from 0 within each cloud, without a task for a whole cloud."""
    return numbering.numbered_within(_t(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], "id").select("user_id", "event_id", "id")


@query("WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS point_index, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.vec_id, count(*) AS points, count(b.v) AS both FROM u a LEFT JOIN u b ON b.vec_id = a.vec_id AND a.point_index = b.point_index AND b.point_index <= 20 + b.vec_id % 7 GROUP BY ALL")
def positional_left_join(spark, sf):
    """A shorter array leaves the points beyond its end."""
    u = payload.unpacked(_t(spark, sf, "embeddings"), "vec_id", "embedding")
    other = u.where(F.col("point_index") <= 20 + F.col("vec_id") % 7).withColumnRenamed("value", "other")
    return payload.positional(u, other, "vec_id", "left").groupBy("vec_id").agg(F.count("*").alias("points"), F.count("other").alias("both"))


@query("SELECT user_id, 'value' AS name, string_agg(coalesce(CASE WHEN event_type <> 'view' THEN event_id END::VARCHAR, '-'), ',' ORDER BY ts, event_id) AS items FROM events GROUP BY ALL HAVING count(CASE WHEN event_type <> 'view' THEN 1 END) > 0")
def packed_attributes(spark, sf):
    """Attributes in long form, an array for each cell that has any, its nulls in place."""
    e = _t(spark, sf, "events")
    points = e.select("user_id", F.struct("ts", "event_id").alias("point_index"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("value"), F.lit(None).cast("long").alias("absent"))
    a = payload.packed_attributes(points, "user_id", ["value", "absent"])
    return a.select("user_id", "name", F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",").alias("items"))


@query("SELECT 'click' AS name, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS cells, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) = count(DISTINCT user_id) AS is_consistent FROM events UNION ALL SELECT 'rare', count(DISTINCT CASE WHEN event_id % 50 = 0 THEN user_id END), count(DISTINCT CASE WHEN event_id % 50 = 0 THEN user_id END) = count(DISTINCT user_id) FROM events")
def attribute_presence(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "click", F.col("value")).alias("click"), F.when(F.col("event_id") % 50 == 0, F.col("value")).alias("rare"), F.lit(None).cast("double").alias("never"))
    return payload.attribute_presence(e, "user_id", ["click", "rare", "never"])


# ---------------------------------------------------------------- sources
@query(
    "WITH m AS (SELECT event_type AS topic, event_id, value, epoch_us(ts) * 1000 AS ns, min(epoch_us(ts) * 1000) OVER () AS a, max(epoch_us(ts) * 1000) OVER () AS b FROM events), s AS (SELECT *, least((ns - a) // 86400000000000, greatest(1, CAST(ceil((b - a) / 86400000000000) AS BIGINT)) - 1) AS slice FROM m WHERE topic IN ('click', 'view')) "
    "SELECT topic, slice, count(*) * 2 AS points, round(sum(value * 2), 4) AS total, min(event_id // 100) AS first_chunk, max(event_id % 65536)::INTEGER AS last_message FROM s GROUP BY ALL"
)
def message_slices(spark, sf):
    """Points of messages by topic and slice, with where they came from."""
    e = _t(spark, sf, "events").withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    first, last = e.agg(F.min("ns"), F.max("ns")).first()
    cloud = F.array(*[F.struct(V.point("value", k, 0).alias("position"), F.lit(None).cast("long").alias("ts_ns"), F.lit(1.0).cast("float").alias("intensity")) for k in (0, 1)])
    bag = e.select(F.col("event_type").alias("topic"), F.col("ns").alias("ts_ns"), F.floor(F.col("event_id") / 100).alias("chunk_id"), (F.col("event_id") % 65536).cast("int").alias("message_id"), F.lit("lidar").alias("frame"), cloud.alias("points"))
    p = messages.sliced_points(bag.where(F.col("topic").isin("click", "view")), first, last, 86400 * 10**9)
    return p.groupBy("topic", F.col("slice").cast("long").alias("slice")).agg(F.count("*").alias("points"), _r(F.sum("position.x"), 4).alias("total"), F.min("mcap_chunk_id").alias("first_chunk"), F.max("mcap_message_id").alias("last_message"))


@query(_POSES + _POSED + " SELECT event_id, round(sx + 3 * cos(turn) - sin(turn), 5) AS x, round(sy + 3 * sin(turn) + cos(turn), 5) AS y, round(sz + 2, 5) AS z FROM s")
def global_frame(spark, sf):
    """The point (3, 1, 2) of each event's frame, put where the frame then is."""
    points, _, poses = _timed(spark, sf)
    local = points.select("event_id", F.col("recording_id").alias("frame"), "ts_ns", V.point(3, 1, 2).alias("position"))
    g = messages.in_global_frame(local, poses.select(F.col("trajectory_id").alias("path"), "ts_ns", "position", "orientation"))
    return g.select("event_id", *[_r(F.col(f"position.{c}"), 5).alias(c) for c in "xyz"])


@query("SELECT user_id AS path, count(*) AS samples, CASE WHEN count(*) > 1 THEN 'timed' ELSE 'sequence' END AS domain, CASE WHEN count(*) > 1 THEN 'linear' ELSE 'step' END AS interpolation_type, 'constant' AS extrapolation_type FROM events WHERE event_id % 37 = 0 GROUP BY ALL")
def trajectory_kinds(spark, sf):
    return messages.trajectory_kinds(_t(spark, sf, "events").where("event_id % 37 = 0").withColumnRenamed("user_id", "path"))


# ---------------------------------------------------------------- city model, entities, cleaning
@query(_BOX + f", {_INFO} SELECT s_suppkey AS id, feature_object_id, feature_class_name, feature_object_name, CASE WHEN s_suppkey % 5 = 0 THEN 'lane ' || s_suppkey END AS property_lane_type FROM b JOIN info ON info.feature_id = s_suppkey WHERE x + 1 >= 5 AND y + 1 >= 5 AND x <= 65 AND y <= 700")
def feature_list_in_box(spark, sf):
    f = _boxes(spark, sf).select(F.col("s_suppkey").alias("id"), "envelope", F.col("s_nationkey").alias("objectclass_id")).join(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("objectid")), "id")
    classes = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("classname"))
    info = feature_info(spark, sf)
    prop = lambda df, name, namespace, value: df.select("feature_id", F.lit(14).alias("datatype_id"), F.lit(namespace).alias("namespace_id"), F.lit(name).alias("name"), value.alias("val_string"))
    properties = prop(info.where("feature_object_name is not null"), "name", 1, F.col("feature_object_name")).unionByName(prop(info.where("feature_id % 5 = 0"), "opendrive_lane_type", 2, F.concat(F.lit("lane "), "feature_id"))).unionByName(prop(info, "name", 2, F.lit("other namespace")))
    return features.feature_list(f, classes, properties, lo=(5, 5, -1), hi=(65, 700, 1))


@query(_BOX + ", k AS (SELECT count(*) AS after FROM b WHERE x IS NULL OR (x + 1 >= 5 AND y + 1 >= 5 AND x <= 45 AND y <= 50)) SELECT (SELECT count(*) FROM b) AS before, after, (SELECT count(*) FROM b) - after AS deleted FROM k")
def crop_counts(spark, sf):
    return features.crop(_boxes(spark, sf), (5, 5, -1), (45, 50, 1))[1]


@query(_BOX + ", k AS (SELECT s_suppkey FROM b WHERE x IS NULL OR (x + 1 >= 5 AND y + 1 >= 5 AND x <= 45 AND y <= 50)) SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM k)")
def crop_children(spark, sf):
    """What hangs on a cropped feature goes with it."""
    kept, _ = features.crop(_boxes(spark, sf).withColumnRenamed("s_suppkey", "id"), (5, 5, -1), (45, 50, 1))
    return entities.cascaded(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), kept, "l_suppkey")


@query("SELECT c_custkey AS id, o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def entity_chain(spark, sf):
    """Inner joins from the many to the one, four tables deep."""
    t = lambda n: _t(spark, sf, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("c_custkey").alias("id"), "o_orderkey", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return entities.duplicates(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT p_partkey, p_type FROM part WHERE NOT (p_size % 2 + 1 = 1 AND p_type IN ('STANDARD', 'ECONOMY'))")
def clean_names(spark, sf):
    """Rows of one namespace go by a list of names."""
    p = _t(spark, sf, "part").select("p_partkey", "p_type", F.col("p_type").alias("name"), (F.col("p_size") % 2 + 1).alias("namespace_id"))
    return entities.without_names(p, ["STANDARD", "ECONOMY"]).select("p_partkey", "p_type")


@query("SELECT s_name AS name, n_name AS class, row_number() OVER (ORDER BY n_name, s_name) AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def export_order(spark, sf):
    j = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return numbering.ranked(j.select(F.col("s_name").alias("name"), F.col("n_name").alias("class")), ["class", "name"], "place").select("name", "class", "place")


# ---------------------------------------------------------------- functions
@query(_VEC + "SELECT vec_id, round((ax + ex) / 2, 6) AS mx, round((az + ez) / 2, 6) AS mz, round((greatest(ax, ex) - least(ax, ex)) * (greatest(ay, ey) - least(ay, ey)) * (greatest(az, ez) - least(az, ez)), 6) AS volume, least(ax, ex) <= 0.5 AND greatest(ax, ex) >= -0.5 AND least(ay, ey) <= 0.5 AND greatest(ay, ey) >= -0.5 AND least(az, ez) <= 0.5 AND greatest(az, ez) >= -0.5 AS meets FROM v")
def midpoints_and_boxes(spark, sf):
    v = _vectors(spark, sf).select("vec_id", G.midpoint(F.col("a"), F.col("b")).alias("m"), G.box_of(F.array("a", "b")).alias("box"))
    unit = G.make_envelope(V.point(-0.5, -0.5, -0.5), V.point(0.5, 0.5, 0.5))
    return v.select("vec_id", _r(F.col("m.x")).alias("mx"), _r(F.col("m.z")).alias("mz"), _r(G.box_volume(F.col("box"))).alias("volume"), G.boxes_meet(F.col("box"), unit).alias("meets"))


@query("SELECT event_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS stamp, replace(event_type || '/' || user_id, '/', '_') AS file FROM events")
def stamps_and_file_names(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", T.rfc3339(F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("stamp"), T.clean_name(F.concat_ws("/", "event_type", F.col("user_id").cast("string"))).alias("file"))


@query(_VEC + "SELECT vec_id, round(ax * ex + ay * ey + az * ez, 6) AS d, round(ay * ez - az * ey, 6) AS cx, round(sqrt(ax * ax + ay * ay + az * az), 6) AS range FROM v")
def session_sql(spark, sf):
    """The same functions in SQL text, once they are registered in the session."""
    session_functions.register(spark)
    _vectors(spark, sf).createOrReplaceTempView("beamlake_vectors")
    out = spark.sql("SELECT vec_id, v3_dot(a, b) AS d, v3_cross(a, b).x AS cx, v3_spherical(a).range AS range FROM beamlake_vectors")
    return out.select("vec_id", *[_r(F.col(c)).alias(c) for c in ("d", "cx", "range")])


@query("SELECT s_suppkey, 'MULTIPOINT Z ((' || s_suppkey || ' 1 2.5),(3 4 5))' AS wkt, s_suppkey::DOUBLE AS x, 5.0::DOUBLE AS z, 2 AS n FROM supplier")
def points_from_text(spark, sf):
    s = _t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("MULTIPOINT Z (("), "s_suppkey", F.lit(" 1 2.5),(3 4 5))")).alias("wkt"))
    p = s.withColumn("p", G.parse_points_wkt(F.col("wkt")))
    return p.select("s_suppkey", "wkt", F.col("p")[0]["x"].alias("x"), F.col("p")[1]["z"].alias("z"), F.size("p").alias("n"))


#: Degrees of the default zenith bins, for callers that print them.
ZENITH_DEGREES = tuple(round(math.degrees(b)) for b in bins.ZENITH_BOUNDS)
