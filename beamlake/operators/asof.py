"""As-of joins in both directions by one window over poses and queries together: one sort, no nested loop.

A trajectory is cut into slices of time, each a window of its own; what a slice needs from its neighbours is one pose from each side,
taken from a table of one row for each slice. So a trajectory of any length is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamlake.functions.vector import add, scale, slerp, sub

SLICE_NS = 60 * 10**9


def neighbours(poses: DataFrame, queries: DataFrame, key: str, time: str, carry: list[str], tie: str | None = None, slice_ns: int = SLICE_NS) -> DataFrame:
    """queries with prev (latest pose at or before) and next (earliest pose after), structs of `time` and `carry`, or null.

    Of poses at one time the largest `tie` is the previous one and the smallest the next. A query of null time has neither."""
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    bucket = F.floor(F.col(time) / F.lit(slice_ns)).alias("_slice")
    pose = F.struct(F.col(time), *carry).alias("_pose")
    others = [c for c in queries.columns if c not in (key, time)]
    given = poses.where(F.col(time).isNotNull()).select(key, time, bucket, pose, F.lit(0).alias("_query"), order.alias("_tie"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in others])
    none = F.lit(None).cast(given.schema["_pose"].dataType)
    asked = queries.select(key, time, bucket, none.alias("_pose"), F.lit(1).alias("_query"), F.lit(None).cast("long").alias("_tie"), *others)
    rows = given.unionByName(asked)
    at = F.struct(time, "_tie")
    ends = rows.groupBy(key, "_slice").agg(F.max_by("_pose", F.when(F.col("_query") == 0, F.struct(F.col(time), F.col("_tie")))).alias("_last"), F.min_by("_pose", F.when(F.col("_query") == 0, at)).alias("_first"))
    slices = Window.partitionBy(key).orderBy("_slice")
    ends = ends.select(key, "_slice", F.last("_last", True).over(slices.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(slices.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    w = Window.partitionBy(key, "_slice").orderBy(time, "_query", "_tie")
    prev = F.last("_pose", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("_pose", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    within = rows.withColumns({"_prev": prev, "_next": nxt}).where("_query = 1")
    joined = within.join(ends, [key, "_slice"], "left")
    return joined.select(*queries.columns, F.coalesce("_prev", "_before").alias("prev"), F.coalesce("_next", "_after").alias("next"))


def ratio(q: Column, prev: Column, nxt: Column) -> Column:
    """From differences of whole nanoseconds, so that no precision is lost."""
    return (q - prev).cast("double") / (nxt - prev).cast("double")


def interpolated(time: str, mode: str = "linear", degenerate: str = "null") -> tuple[Column, Column]:
    """(position, orientation) of rows with prev and next structs of (time, position, orientation).

    An exact match is that pose; between two poses linear or step; outside the nearest pose."""
    p, n, q = F.col("prev"), F.col("next"), F.col(time)
    exact, both = p[time] == q, p.isNotNull() & n.isNotNull()
    t = ratio(q, p[time], n[time])
    between = add(p["position"], scale(sub(n["position"], p["position"]), t)) if mode == "linear" else p["position"]
    turned = F.when(p["orientation"].isNotNull() & n["orientation"].isNotNull(), slerp(p["orientation"], n["orientation"], t, degenerate)).otherwise(p["orientation"]) if mode == "linear" else p["orientation"]
    outside = F.coalesce(p, n)
    return (F.when(exact, p["position"]).when(both, between).otherwise(outside["position"]), F.when(exact, p["orientation"]).when(both, turned).otherwise(outside["orientation"]))
