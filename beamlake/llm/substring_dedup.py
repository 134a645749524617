"""Substring dedup over words by level-wise doubling.

The first level takes runs of a quarter of the window's length (of each window the one that its words choose, so none is missed). Runs
found once are done; those repeated are extended to twice the length (again to one run for each window, which depends on the window
alone), and so on level after level until the windows themselves are compared or no candidate survives."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import doubled, map_arrow, removed, run_at, table, words_of, written
from beamlake.llm.repeats import by_document, covered, repeated, span_arrays, text_tag, with_text, word_units

WINDOW = 20


def level_lengths(window: int) -> list[int]:
    """Lengths of the levels: a quarter of the window, doubled until it is reached."""
    out = [max(1, window // 4)]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


def extended_runs(docs: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, tag, a, weight, rest): runs of the second level's length for the windows of the candidates. Windows with one run
    share a row; rest holds their hashes at the further levels, window after window. weight: 2 for a class that has others."""
    lengths = level_lengths(window)

    def extend(batch):
        out: list[list] = [[], [], [], [], [], []]
        doc_ids, tags, texts, asked = (batch.column(i).to_pylist() for i in range(4))
        for doc, tag, h, found in zip(doc_ids, tags, word_units(texts), asked, strict=True):
            steps = doubled(h, window)
            first = run_at(steps, lengths[0])
            for s in found:
                a, b = s["a"], s["b"]
                near = first[b : b + window - lengths[0] + 1]
                run = np.full(b - a + 1, b + len(near) - 1 - int(near[::-1].argmin()))  # the rightmost least run, that of all these windows
                starts, hashed = np.arange(a, b + 1), []
                for length in lengths[1:]:
                    run = np.minimum(run, starts + window - length)
                    hashed.append((run, run_at(steps, length, run).view(np.int64)))
                edge = np.flatnonzero(np.concatenate([[True], hashed[0][0][1:] != hashed[0][0][:-1]]))
                rest = np.stack([x for _, x in hashed[1:]], axis=1) if len(hashed) > 1 else np.empty((len(starts), 0), np.int64)
                for lo, hi in zip(edge, [*edge[1:], len(starts)], strict=True):
                    for column, v in zip(out, (hashed[0][1][lo], doc, tag, a + lo, 1 + s["others"], rest[lo:hi].ravel()), strict=True):
                        column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return {n: pa.array(c, k) for n, c, k in zip(("key", "doc_id", "tag", "a", "weight", "rest"), out, kinds, strict=True)}

    return map_arrow(with_text(docs, candidates, "a", "b", "others"), extend, "key long, doc_id long, tag int, a int, weight int, rest array<long>", rows=128)


def surviving(rows: DataFrame) -> DataFrame:
    """The rows whose key is found more than once; keys are counted by partial sums, and a hot one is split by the join."""
    return rows.join(rows.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key"), "key")


def repeated_word_spans(docs: DataFrame, window: int = WINDOW, seen: list | None = None) -> DataFrame:
    """spans(doc_id, tag, a, b): starts a..b (in words) of windows that also start earlier, by smaller doc_id or place.

    seen: takes (length, candidate rows) of each level, for whoever wants to know."""
    lengths = level_lengths(window)
    spans, candidates = repeated(docs, word_units, window, lengths[0])
    rows, temporary = written(extended_runs(docs, candidates, window), "runs"), [spans]
    for i, length in enumerate(lengths[1:], 1):
        temporary.append(rows)
        if seen is not None:
            seen.append((length, rows.count()))
        if length == window:
            break
        further = len(lengths) - 1 - i  # hashes that each window still has
        at = F.posexplode(F.expr(f"transform(sequence(0, size(rest) div {further} - 1), i -> slice(rest, i * {further} + 1, {further}))")).alias("i", "own")
        windows = surviving(rows).select("doc_id", "tag", "a", "weight", at)
        rows = written(windows.select(F.col("own")[0].alias("key"), "doc_id", "tag", (F.col("a") + F.col("i")).alias("a"), "weight", F.expr("slice(own, 2, size(own) - 1)").alias("rest")), "runs")
    place = F.struct("doc_id", "tag", "a")
    first = rows.groupBy("key").agg(F.min(place).alias("first"), F.sum("weight").alias("n")).where("n > 1").select("key", "first")
    later = rows.join(first, "key").where(place != F.col("first")).select("doc_id", "tag", "a", F.col("a").alias("b"))
    found = written(spans.union(later), "word-spans")
    for used in temporary:
        removed(docs.sparkSession, used)
    return found


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of docs(doc_id, text).

    Null and empty texts have no words. Rows of a null doc_id are compared with nothing and keep all. Repeated rows are answered alike,
    as one; rows of one doc_id and different texts are different documents, in an order that their texts fix. Texts of any length are
    taken whole; an empty table gives no rows; other columns are not read."""

    def cut(batch):
        n, gone, sha, kept = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), span_arrays(batch.column(2)), strict=True):
            words = words_of(text, lower=False)
            out = covered(len(words), spans, window)
            rest = b" ".join(words if spans is None else [words[i] for i in np.flatnonzero(~out)])
            n.append(len(words))
            gone.append(int(out.sum()))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "replace"))
        return {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())}

    spans = by_document(repeated_word_spans(docs, window))
    asked = docs.select("doc_id", text_tag(), "text").join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return map_arrow(asked, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_level_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents")).drop("kept")
