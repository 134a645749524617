"""Entities: get-or-create, duplicates, cascades, pattern deletes, box predicates, constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamlake.operators.numbering import ranked


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing(id, keys...) with a further id for each key tuple of new that it lacks, in key order; null keys are equal."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    same = [existing[k].eqNullSafe(new[k]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    fresh = ranked(new.select(*keys).distinct().alias("new").join(existing, condition, "left_anti"), keys)
    return existing.select("id", *keys).unionByName(fresh.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).cast(existing.schema["id"].dataType).alias("id"), *keys))  # one row


def duplicates(df: DataFrame, keys: list[str], nulls_equal: bool = False) -> DataFrame:
    rows = df if nulls_equal else df.dropna(subset=keys)
    return rows.groupBy(*keys).count().where("count > 1")


def cascaded(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The child's rows whose parent is left (or is null)."""
    return child.where(F.col(key).isNull()).unionByName(child.join(parents.select(F.col("id").alias(key)), key, "left_semi").select(*child.columns))


def without_names(payload: DataFrame, names: list[str]) -> DataFrame:
    return payload.where(~((F.col("namespace_id") == 1) & F.col("name").isin(names)))


def without_pattern(properties: DataFrame, pattern: str) -> DataFrame:
    """Rows whose name is not like the pattern, where an underscore stands for any character; null names stay."""
    return properties.where(~F.coalesce(F.col("name").like(pattern), F.lit(False)))


def box_overlap(envelope: Column, lo: tuple | None = None, hi: tuple | None = None) -> Column:
    """Inclusive overlap; either corner may be missing."""
    out = F.lit(True)
    for i, c in enumerate("xyz"):
        if lo is not None:
            out = out & (envelope[f"{c}max"] >= float(lo[i]))
        if hi is not None:
            out = out & (envelope[f"{c}min"] <= float(hi[i]))
    return out


def cropped(features: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """Features that overlap the box, or have no envelope; both corners are required."""
    if lo is None or hi is None:
        raise ValueError("both corners are required")
    inside = box_overlap(F.col("envelope"), lo, hi)
    return features.where(inside | inside.isNull())


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each failed check; null is no failure."""
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return df.select("*", F.explode(failed).alias("violation"))
