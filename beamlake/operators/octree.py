"""Leaf octants of at most so many points: counts at the deepest level are rolled up, and each point takes the shallowest octant that
is small enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.operators.numbering import ranked

CELL = ("level", "cell_x", "cell_y", "cell_z")


def roots(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, xlo, ylo, zlo, side) of each cloud: the cube at the least corner whose side is the largest extent (1 if that is 0)."""
    box = points.groupBy(*by).agg(*[f(c).alias(f"{c}{s}") for c in "xyz" for s, f in (("lo", F.min), ("hi", F.max))])
    extent = F.greatest(*[F.col(f"{c}hi") - F.col(f"{c}lo") for c in "xyz"])
    return box.select(*by, "xlo", "ylo", "zlo", F.when(extent > 0, extent).otherwise(1.0).alias("side"))


def octants(points: DataFrame, max_points: int = 100_000, depth: int = 8, by: list[str] | None = None) -> DataFrame:
    """points(x, y, z, ...) with level, cell_x, cell_y, cell_z; `by` names the columns that tell clouds apart (none: all is one cloud)."""
    by, root = list(by or []), roots(points, list(by or []))
    placed = points.join(root, by) if by else points.crossJoin(F.broadcast(root))  # one row
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}lo")) / F.col("side") * (1 << depth)).cast("int"), F.lit((1 << depth) - 1))
    deep = placed.select(*points.columns, *[cell(c).alias(f"_{c}") for c in "xyz"])
    counts = deep.groupBy(*by, "_x", "_y", "_z").agg(F.count("*").alias("_n"))
    up = lambda level: F.struct(F.lit(level).alias("level"), *[F.shiftright(f"_{c}", depth - level).alias(f"cell_{c}") for c in "xyz"])
    above = counts.select(*by, "_x", "_y", "_z", "_n", F.inline(F.array(*[up(k) for k in range(depth + 1)])))
    small = above.groupBy(*by, *CELL).agg(F.sum("_n").alias("n")).where((F.col("n") <= max_points) | (F.col("level") == depth)).select(*by, *CELL)
    leaf = above.join(small, [*by, *CELL]).groupBy(*by, "_x", "_y", "_z").agg(F.min(F.struct(*CELL)).alias("leaf"))
    return deep.join(leaf, [*by, "_x", "_y", "_z"]).select(*points.columns, "leaf.*")


def cells(points: DataFrame, root: DataFrame, by: str = "point_cloud_id") -> DataFrame:
    """Cells of points with octants (x, y, z, ts_ns, sensor_position): ids in the order of cloud, level and place, the octant's box, the
    points' box, the sensors' box (null if no point has one), first and last time, count."""
    box = lambda of, what: F.struct(*[f(of(c)).alias(f"{c}{s}") for s, f in (("min", F.min), ("max", F.max)) for c in "xyz"]).alias(what)
    found = points.groupBy(by, *CELL).agg(box(F.col, "point_envelope"), box(lambda c: F.col(f"sensor_position.{c}"), "sensor_envelope"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count("*").alias("point_count"))
    placed = found.join(root, by)
    size = F.col("side") / F.pow(F.lit(2.0), F.col("level"))
    edge = lambda c, k: F.col(f"{c}lo") + (F.col(f"cell_{c}") + k) * size
    octant = F.struct(*[edge(c, k).alias(f"{c}{s}") for s, k in (("min", 0), ("max", 1)) for c in "xyz"])
    date = lambda c: F.timestamp_micros(F.call_function("div", F.col(c), F.lit(1000)))
    sensor = F.when(F.col("sensor_envelope.xmin").isNotNull(), F.col("sensor_envelope"))
    return ranked(placed, [by, *CELL], "id").select(F.col("id").cast("long").alias("id"), by, "level", *[F.col(f"cell_{c}").alias(c) for c in "xyz"], date("first_ns").alias("start_date"), date("last_ns").alias("end_date"), octant.alias("cell_envelope"), "point_envelope", sensor.alias("sensor_envelope"), "point_count")
