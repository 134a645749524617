"""Points and beam segments associated with surfaces within a 3D distance: grids by extent, exact kernel, first hit.

Polygons are dealt to grids by their extent, so each lies in at most eight voxels of a grid that fits it; points and segments look it up
in every grid there is (powers of two: a few dozen at most). A pair that shares several voxels counts only in that of the corner where
both boxes begin, so no duplicate arises and nothing has to be shuffled to remove it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamlake.functions.geometry import azimuth, box_of, boxes_meet, edges, zenith
from beamlake.functions.vector import line_plane_parameter, sub
from beamlake.operators.kernel import polygon_distance, polygon_meets_box
from beamlake.operators.payload import ordered

_XYZ = "xyz"
#: What the beam variant measures, and what both have.
BEAM_MEASURES = ("beam_distance", "zenith", "azimuth", "t")
MEASURES = ("polygon_id", "surface_distance", *BEAM_MEASURES)


def float32(x: float) -> float:
    """The parameter as the measures have it."""
    import numpy as np

    return float(np.float32(x))


def shapes(polygons: DataFrame) -> DataFrame:
    """(polygon_id, normal, centroid, edges, box) of polygons(id, exterior, holes, normal, centroid) with a normal."""
    return polygons.where("normal is not null").select(F.col("id").alias("polygon_id"), "normal", "centroid", edges(F.col("exterior"), F.col("holes")).alias("edges"), box_of(F.col("exterior")).alias("box"))


def _voxels(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def _segment_box() -> Column:
    return F.struct(*[f(f"p0.{c}", f"p1.{c}").alias(f"{c}{s}") for s, f in (("min", F.least), ("max", F.greatest)) for c in _XYZ])


def candidates(beams: DataFrame, polygons: DataFrame, buffer: float) -> DataFrame:
    """beams (with p0, p1 and any other columns) paired with the polygons within `buffer`: polygon_id, normal, centroid, distance.

    The grids are one small array; the voxels of polygons are broadcast only where Spark finds them small."""
    size = F.pow(F.lit(2.0), F.col("grid"))
    extent = F.greatest(*[F.col(f"box.{c}max") - F.col(f"box.{c}min") for c in _XYZ]) + 2 * buffer
    walls = shapes(polygons).withColumn("grid", F.greatest(F.ceil(F.log2(extent)), F.lit(0)).cast("int"))
    grids = walls.agg(F.collect_set("grid").alias("grids"))
    for c in _XYZ:
        walls = walls.withColumn(f"v{c}", F.explode_outer(_voxels(F.col(f"box.{c}min") - buffer, F.col(f"box.{c}max") + buffer, size)))
    # outer: a plain explode lets Spark infer filters, which it evaluates below, on whatever long expressions p0 and p1 come from;
    # rows without a segment have no voxel and meet nothing
    cut = beams.withColumn("grids", grids.scalar()).withColumn("grid", F.explode_outer("grids")).drop("grids").withColumn("own", _segment_box())
    for c in _XYZ:
        cut = cut.withColumn(f"v{c}", F.explode_outer(_voxels(F.col(f"own.{c}min"), F.col(f"own.{c}max"), size)))
    begin = lambda c: F.greatest(F.col(f"own.{c}min"), F.col(f"box.{c}min") - buffer)
    once = [F.floor(begin(c) / size) == F.col(f"v{c}") for c in _XYZ]
    place = ["grid", *[f"v{c}" for c in _XYZ]]
    near = cut.join(walls, place).where(boxes_meet(F.col("box"), F.col("own"), buffer) & once[0] & once[1] & once[2])
    found = near.withColumn("distance", polygon_distance(F.col("p0"), F.col("p1"), F.col("edges"), F.col("normal")).cast("float"))
    return found.where(F.col("distance") <= F.lit(float32(buffer)).cast("float")).select(*beams.columns, "polygon_id", "normal", "centroid", "distance")


def in_envelope(found: DataFrame, beams: DataFrame, polygons: DataFrame, cell: str) -> DataFrame:
    """The candidates whose polygon meets the box, not grown, of all points and segments of the candidate's cell.

    Only pairs of a cell and a polygon that are candidates are tested, each once."""
    ends = [f(F.least(f"p0.{c}", f"p1.{c}") if s == "min" else F.greatest(f"p0.{c}", f"p1.{c}")).alias(f"{c}{s}") for s, f in (("min", F.min), ("max", F.max)) for c in _XYZ]
    boxes = beams.groupBy(cell).agg(*ends).select(cell, F.struct(*[f"{c}{s}" for s in ("min", "max") for c in _XYZ]).alias("cell_box"))
    asked = found.select(cell, "polygon_id").distinct().join(boxes, cell).join(shapes(polygons).select("polygon_id", "normal", "edges"), "polygon_id")
    held = asked.where(polygon_meets_box(F.col("cell_box"), F.col("edges"), F.col("normal"))).select(cell, "polygon_id")
    return found.join(held, [cell, "polygon_id"], "left_semi")


def _best(found: DataFrame, key: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """For each key the columns of the least row: a partial minimum, no sort and no window."""
    least = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("least")
    return found.groupBy(*key).agg(least).select(*key, *[F.col(f"least.{c}").alias(n) for c, n in columns.items()])


def nearest_surface(points: DataFrame, polygons: DataFrame, key: list[str], buffer: float = 0.5, prefilter: str = "none", cell: str | None = None) -> DataFrame:
    """points(key, position) with polygon_id and surface_distance (null if none is near); ties go to the smaller polygon id.

    prefilter: "none", or "envelope" for surfaces that meet the box of the cell's points alone (results then depend on the cells)."""
    used = points.select(*dict.fromkeys([*key, *([cell] if cell else [])]), F.col("position").alias("p0"), F.col("position").alias("p1"))
    found = candidates(used, polygons, buffer)
    if prefilter == "envelope":
        found = in_envelope(found, used, polygons, cell)
    best = _best(found, key, ["distance", "polygon_id"], {"distance": "surface_distance", "polygon_id": "polygon_id"})
    return points.join(best, key, "left")


def first_hit(beams: DataFrame, polygons: DataFrame, key: list[str], line_buffer: float = 0.05, max_t: float = 1.0, prefilter: str = "none", cell: str | None = None, reported: bool = False) -> DataFrame:
    """beams(key, sensor_position, position, p0, p1) with the first confirmed surface and its measures.

    Confirmed: hit from the front and |t| <= max_t / 2; first: the least signed t, then the distance, then the polygon id.
    reported: also the point's own distance to that surface."""
    used = beams.select(*dict.fromkeys([*key, *([cell] if cell else [])]), "sensor_position", "position", "p0", "p1")
    found = candidates(used, polygons, line_buffer)
    if prefilter == "envelope":
        found = in_envelope(found, used, polygons, cell)
    line = (F.col("sensor_position"), F.col("position"))
    found = found.withColumns({
        "zenith": zenith(F.col("normal"), *line).cast("float"),
        "azimuth": azimuth(F.col("normal"), F.col("centroid"), *line).cast("float"),
        "t": line_plane_parameter(F.col("position"), sub(F.col("position"), F.col("sensor_position")), F.col("centroid"), F.col("normal")).cast("float"),
    }).where(F.col("zenith").isNotNull() & F.col("t").isNotNull() & (F.abs("t") <= F.lit(float32(max_t)).cast("float") / 2))
    best = _best(found, key, ["t", "distance", "polygon_id"], {"t": "t", "distance": "beam_distance", "polygon_id": "polygon_id", "zenith": "zenith", "azimuth": "azimuth"})
    out = beams.join(best, key, "left")
    if not reported:
        return out
    edge = shapes(polygons).select("polygon_id", "edges", F.col("normal").alias("_normal"))
    own = polygon_distance(F.col("position"), F.col("position"), F.col("edges"), F.col("_normal")).cast("float")
    return out.join(edge, "polygon_id", "left").withColumn("surface_distance", own).drop("edges", "_normal")


def capable_cells(points: DataFrame, cell: str) -> DataFrame:
    """(cell, has_beams): a cell takes the beam variant if beam, uncertainty segment, point and direction are there at all."""
    has = [F.max(F.col(c).isNotNull()) for c in ("sensor_position", "p0", "position", "direction")]
    return points.groupBy(cell).agg((has[0] & has[1] & has[2] & has[3]).alias("has_beams"))


def associate(points: DataFrame, polygons: DataFrame, cell: str, index: str, point_buffer: float = 0.5, line_buffer: float = 0.05, max_t: float = 1.0, prefilter: str = "envelope") -> DataFrame:
    """points(cell, index, position, sensor_position, direction, p0, p1, ...) with MEASURES; earlier ones are replaced.

    Cells with beams take the first hit, the others the nearest surface (and no beam measures). All points stay."""
    points = points.drop(*MEASURES)
    flagged = points.join(capable_cells(points, cell), cell)
    key = [cell, index]
    beams = first_hit(flagged.where("has_beams"), polygons, key, line_buffer, max_t, prefilter, cell, reported=True)
    near = nearest_surface(flagged.where("not has_beams"), polygons, key, point_buffer, prefilter, cell)
    near = near.withColumns({m: F.lit(None).cast("float") for m in BEAM_MEASURES})
    return beams.unionByName(near).drop("has_beams").select(*points.columns, *MEASURES)


def candidate_count(points: DataFrame, polygons: DataFrame, buffer: float) -> DataFrame:
    """(candidates, associated): pairs within the buffer, and points that have one. points has p0 and p1 and one row for each point."""
    numbered = points.withColumn("_row", F.monotonically_increasing_id())
    return candidates(numbered.select("_row", "p0", "p1"), polygons, buffer).agg(F.count("*").alias("candidates"), F.count_distinct("_row").alias("associated"))


def packed_measures(points: DataFrame, cell: str, index: str) -> DataFrame:
    """A row for each cell: each measure as an array in point order, nulls included."""
    return points.groupBy(cell).agg(*[ordered(F.col(index), F.col(m)).alias(m) for m in MEASURES])
