"""Points as rows and as attribute arrays of cells, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpacked(cells: DataFrame, key: str, array: str, value: str = "value") -> DataFrame:
    """(key, point_index from 1, value); null elements stay."""
    return cells.select(key, F.posexplode(array).alias("pos", value)).select(key, (F.col("pos") + 1).alias("point_index"), value)


def packed(points: DataFrame, key: str, value: str = "value", out: str = "values") -> DataFrame:
    """Arrays in point order, with their nulls."""
    return points.groupBy(key).agg(ordered(F.col("point_index"), F.col(value)).alias(out))


def ordered(index: Column, value: Column) -> Column:
    """Aggregate: the values in the order of their index, nulls included."""
    rows = F.array_sort(F.collect_list(F.struct(index.alias("i"), value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def packed_attributes(points: DataFrame, key: str, attributes: list[str], index: str = "point_index") -> DataFrame:
    """(key, name, values): long form, one row for each cell and attribute of one type that the cell has at all."""
    rows = points.groupBy(key).agg(*[ordered(F.col(index), F.col(a)).alias(a) for a in attributes])
    long = rows.select(key, F.inline(F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).alias("values")) for a in attributes])))
    return long.where(F.exists("values", lambda v: v.isNotNull()))


def positional(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return left.join(right, [key, "point_index"], how)


def attribute_presence(points: DataFrame, cell: str, attributes: list[str]) -> DataFrame:
    """(name, cells, is_consistent): in how many cells an attribute is there, and whether in all; absent ones have no row."""
    has = points.groupBy(cell).agg(*[F.max(F.col(a).isNotNull().cast("int")).alias(a) for a in attributes])
    counts = has.agg(F.count("*").alias("_all"), *[F.sum(a).alias(a) for a in attributes])
    rows = counts.select("_all", F.inline(F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).alias("cells")) for a in attributes])))
    return rows.where("cells > 0").select("name", "cells", (F.col("cells") == F.col("_all")).alias("is_consistent"))
