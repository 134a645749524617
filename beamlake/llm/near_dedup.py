"""Near-duplicates by SuperMinHash: signatures, banding, verification on full shingle sets, union-find grouping.

Documents with equal shingle sets become one class first, so copies cost nothing further. A bucket is not expanded into all pairs: its
members are compared with one pivot, which settles families of close copies; what then still spans several components is compared
in blocks of sets, whose pairs never become rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import U64, components, map_arrow, mixed, one_blas_thread, runs_hashed, table, text_hashes, written

#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^5)^32 < 4e-6.
BANDS, BAND_ROWS = 32, 5
#: Ids of a bucket up to which its pairs are listed, and ids of a block beyond; parts of a key, and ids up to which they have one pivot.
SMALL_BUCKET, BLOCK, PARTS, WIDE = 8, 256, 32, 64
_SHIFT = U64(48)


def shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of the runs of k words (of all words if there are fewer)."""
    return [np.unique(runs_hashed(h, min(k, len(h)))[0]) if len(h) else h for h in text_hashes(texts, lower=True)]


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash: element e gives its j-th slot, of a permutation of its own, the value j + r(e, j); a slot keeps its least value.

    All elements take step j together, so the signature is that of the element-wise algorithm; no step follows once every slot
    holds less than the next step could give."""
    out, n, order = np.full(m, np.iinfo(np.uint64).max, U64), len(elements), None
    rows = np.arange(n)
    for j in range(m):
        draw = mixed(elements + U64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((draw >> U64(32)) * U64(m - j) >> U64(32)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.int16), (n, 1))
                order[rows, first], order[:, 0] = 0, first
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        value = U64(j) << _SHIFT | mixed(draw) >> U64(16)
        np.minimum.at(out, slot, value)
        if out.max() < U64(j + 1) << _SHIFT:
            break
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)
    for column in signature.reshape(bands, rows).T:
        out = mixed(out + column * U64(0x9E3779B97F4A7C15))
    return out


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    def sign(batch):
        n, digests, keys = [], [], []
        for s in shingles(batch.column(1).to_pylist(), k):
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(band_keys(super_minhash(s, bands * rows), bands, rows).view(np.int64) if len(s) else None)
        return {"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))}

    return map_arrow(docs.select("doc_id", "text"), sign, "doc_id long, n long, digest binary, bands array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def check(batch):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            s, t = (s, t) if len(s) <= len(t) else (t, s)
            if 100 * len(s) < percent * len(t):
                keep.append(False)
                continue
            at = np.searchsorted(t, s)
            same = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            keep.append(100 * same >= percent * (len(s) + len(t) - same))
        mask = pa.array(keep, pa.bool_())
        return {"a": batch.column(0).filter(mask), "b": batch.column(1).filter(mask)}

    one, two = (sets.select(F.col("id").alias(c), F.col("items").alias(f"of_{c}")) for c in "ab")
    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b"), check, "a long, b long")


def block_links(left: list, right: list, percent: int, same: bool) -> list[tuple[int, int]]:
    """One link for each two components between two blocks of (id, component, items); exact counts by incidence products."""
    sets = [[np.frombuffer(r[2], U64) for r in side] for side in (left, right)]
    sizes = [np.array([len(x) for x in side], np.float64) for side in sets]
    shared = np.intersect1d(np.concatenate(sets[0]), np.concatenate(sets[1]))
    both = np.zeros((len(left), len(right)))
    places = []
    for side in sets:
        flat, doc = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.searchsorted(shared, flat)
        hit = shared[np.minimum(at, len(shared) - 1)] == flat if len(shared) else np.zeros(len(flat), bool)
        places.append((doc[hit], at[hit]))
    for first in range(0, len(shared), 4096):
        parts = []
        for (doc, at), side in zip(places, sets, strict=True):
            m, use = np.zeros((len(side), 4096), np.float32), (at >= first) & (at < first + 4096)
            m[doc[use], at[use] - first] = 1
            parts.append(m)
        both += parts[0] @ parts[1].T
    c = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
    link = (100 * both >= percent * (sizes[0][:, None] + sizes[1] - both)) & (c[0][:, None] != c[1])
    out = {}
    for i, j in zip(*np.nonzero(np.triu(link) if same else link), strict=True):
        out.setdefault((min(left[i][1], right[j][1]), max(left[i][1], right[j][1])), (left[i][0], right[j][0]))
    return list(out.values())


def buckets(keyed: DataFrame) -> DataFrame:
    """(key, part, id, low, least, n) of keyed(key, id), for keys of several ids: part is one of PARTS a key's ids are dealt to, low the
    part's least id, least and n the key's. All is counted by partial sums and joined by key and part, so that a key that a large share of all
    documents have is no one's task."""
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy("key", "part").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    whole = parts.groupBy("key").agg(F.min("low").alias("least"), F.sum("n").alias("n")).where("n > 1")
    return dealt.join(parts.select("key", "part", "low").join(whole, "key"), ["key", "part"])


def in_blocks(ids: DataFrame) -> DataFrame:
    """ids(family, c, id) with their block (of_c, k) of some BLOCK ids: large components have blocks of their own (of_c is the component),
    small ones share blocks (of_c is -1). Sizes are partial sums; no family is sorted or numbered."""
    sizes = ids.groupBy("family", "c").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= BLOCK).groupBy("family").agg(F.sum("n").alias("pooled"))
    dealt = sizes.join(small, "family", "left").select("family", "c", F.when(F.col("n") > BLOCK, F.col("c")).otherwise(-1).alias("of_c"), F.ceil(F.when(F.col("n") > BLOCK, F.col("n")).otherwise(F.col("pooled")) / BLOCK).alias("blocks"))
    k = F.pmod(F.xxhash64(F.when(F.col("of_c") < 0, F.col("c")).otherwise(F.col("id"))), F.col("blocks")).cast("int")
    return ids.join(dealt, ["family", "c"]).select("family", "c", "id", "of_c", k.alias("k"))


def crowded_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within families: ids joined by crowded buckets. A family is cut into blocks; blocks are compared with each
    other, except where both lie in one component, so that no pair is a row."""
    families = components(members.select(F.col("id").alias("a"), F.col("least").alias("b")))
    named = members.select("id", "c").distinct().join(families.withColumnRenamed("component", "family"), "id")
    ids = written(in_blocks(named), "families")
    blocks = ids.select("family", F.struct("of_c", "k").alias("i")).distinct()
    apart = "i <= j and not (i.of_c = j.of_c and i.of_c >= 0)"
    cells = written(blocks.join(blocks.withColumnRenamed("i", "j"), "family").where(apart), "cells")
    rows = ids.withColumn("block", F.struct("of_c", "k")).join(sets, "id").select("family", "block", "id", "c", "items")
    one = cells.join(rows.withColumnRenamed("block", "i"), ["family", "i"]).select("family", "i", "j", F.lit(0).alias("side"), "id", "c", "items")
    two = cells.where("i < j").join(rows.withColumnRenamed("block", "j"), ["family", "j"]).select("family", "i", "j", F.lit(1).alias("side"), "id", "c", "items")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        one_blas_thread()
        left, right = ([tuple(r) for r in pdf.loc[pdf["side"] == s, ["id", "c", "items"]].itertuples(index=False)] for s in (0, 1))
        same = key[1] == key[2]
        return pd.DataFrame(block_links(left, left if same else right, percent, same), columns=["a", "b"]).astype("int64")

    return one.union(two).groupBy("family", "i", "j").applyInPandas(compare, "a long, b long")


def linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) over members as of buckets(): ids of one key with similar sets are linked.

    First each bucket's ids are compared with its least one, or, in a wide bucket, with their part's, and these with the bucket's. Buckets
    that still span several components are done in full: small ones pair by pair (each pair once, however many buckets it shares), the
    others by blocks of their families."""
    wide = F.col("n") > WIDE
    star = members.select(F.when(wide, F.col("low")).otherwise(F.col("least")).alias("a"), F.col("id").alias("b"))
    heads = members.where(wide & (F.col("id") == F.col("low"))).select(F.col("least").alias("a"), F.col("low").alias("b"))
    pairs = star.union(heads).where("a <> b").distinct()
    labels = components(written(confirmed(pairs, sets, percent), "links"))
    now = members.join(labels, "id", "left").select("key", "part", "id", "least", "n", F.coalesce("component", "id").alias("c"))
    open_ = now.groupBy("key", "part").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    keys = open_.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("key")
    left = written(now.join(open_.select("key", "part").join(keys, "key"), ["key", "part"]), "left")
    few, many = left.where(F.col("n") <= SMALL_BUCKET), left.where(F.col("n") > SMALL_BUCKET)
    ones, twos = few.where("id <> least").select("key", F.col("id").alias("a"), F.col("c").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    found = confirmed(ones.join(twos, "key").where("a < b and ca <> cb").select("a", "b").distinct(), sets, percent)
    if not many.isEmpty():
        found = found.union(crowded_links(many, sets, percent))
    more = written(found, "links")
    return labels if more.isEmpty() else components(more.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    A null or empty text, or one without words, has no shingles and is linked with nothing. A null doc_id is linked with nothing,
    has a null component and is kept. Repeated rows are answered alike; rows of one doc_id and different texts are one document, linked
    by any of its texts. Texts of any length are taken whole. An empty table gives no rows; other columns are not read."""
    signed = written(signatures(docs, k, bands, rows), "signatures")
    classes = written(signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    named = written(signed.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", "rep"), "named")
    # rows of one doc_id and different texts belong together, whatever their classes
    several = named.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    torn = written(named.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")), "torn")
    reps = signed.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    members = written(buckets(written(reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")).distinct(), "bands")), "buckets")

    def items(batch):
        return {"id": batch.column(0), "items": pa.array([s.tobytes() for s in shingles(batch.column(1).to_pylist(), k)], pa.binary())}

    wanted = docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "tag"])
    sets = written(map_arrow(wanted.select("doc_id", "text"), items, "id long, items binary").where("length(items) > 0"), "sets")
    labels = linked(members, sets, percent)
    if not torn.isEmpty():
        labels = components(torn.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "rep", "doc_id"))
    found = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_super_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
