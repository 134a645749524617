"""Suffix-array dedup over bytes by threshold-bounded interval expansion.

Segments of text that may share a window are laid out in blocks. Of each block the suffixes are ordered up to the threshold, which
gives a Burrows-Wheeler transform; breadth-first backward extension from the empty string meets the common-prefix values in
increasing order and stops at the threshold, so that what has no value by then shares at least that many bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import doubled, map_arrow, removed, run_at, table, written
from beamlake.llm.repeats import FAR_BITS, SIDE_BITS, _spans, by_document, byte_hashes, byte_units, covered, repeated, span_arrays, text_tag, with_text

LENGTH, ANCHOR = 100, 32
#: Bytes of a block, and segments of a key beyond which it is split: an anchor by the bytes beside it, such a part window by window.
BLOCK_BYTES, CROWDED = 1 << 19, 4096
_SEPARATOR, _END = 0xFF, 0xFE  # never in UTF-8


def bounded_suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Starts of the cyclic suffixes, ordered by at least their first `least` bytes; equal ones stand together.

    Doubling: places that are not told apart by their first `length` bytes are ordered by the ranks of the next `length`."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | np.roll(text, -i).astype(np.uint64)
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank, length = np.empty(n, np.int64), 8
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = first  # places before: stays right for all that are told apart already
        open_ = ~(new & np.append(new[1:], True))
        if length >= least or not open_.any():
            return order
        at = np.flatnonzero(open_)
        # the group in the high bits, the rank of what follows in the low ones
        sub = first[at] << 32 | rank[(order[at] + length) % n]
        by = np.argsort(sub)
        order[at], sub = order[at][by], sub[by]
        new[at] = np.concatenate([[True], sub[1:] != sub[:-1]])
        length *= 2


def short_prefixes(text: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """For each place in the order, the common prefix with the place before it, or -1 if it is the threshold or more.

    Intervals of strings of one length are extended to the left by every byte at once; the right end of an extended interval that has
    no value yet gets the length, and only then is the interval extended further."""
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    near = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_symbol[:-1][near]], previous[by_symbol[1:][near]] = by_symbol[1:][near], by_symbol[:-1][near]
    prefix = np.full(n + 1, -1, np.int64)
    prefix[0] = prefix[n] = 0
    low, high = np.array([0]), np.array([n])
    for length in range(threshold):
        size = high - low
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        last, first = at[following[at] >= np.repeat(high, size)], at[previous[at] < np.repeat(low, size)]
        low, high = np.sort(lf[first]), np.sort(lf[last]) + 1
        fresh = prefix[high] < 0
        if length == 0:
            fresh |= high == n
        prefix[high[fresh]] = length
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
    return prefix[:n]


def window_order(payload: list[bytes], rank: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, repeats) of every window in the segments, repeats: an equal one stands in a segment of less rank, or earlier
    in its own. Windows are told apart by the intervals of the transform alone."""
    parts = [np.frombuffer(p, np.uint8) for p in payload]
    size = np.array([len(p) + 1 for p in parts])
    begin = np.cumsum(size) - size
    text = np.full(int(size.sum()) + 1, _SEPARATOR, np.uint8)
    text[-1] = _END
    for p, at in zip(parts, begin, strict=True):
        text[at : at + len(p)] = p
    order = bounded_suffix_order(text, threshold)
    group = np.cumsum(short_prefixes(text, order, threshold) >= 0)
    of = np.append(np.repeat(np.arange(len(parts)), size), 0)[order]
    offset = order - begin[of]
    real = (offset + threshold <= size[of] - 1) & (order < len(text) - 1)
    group, of, offset = group[real], of[real], offset[real]
    by = np.lexsort((offset, rank[of], group))
    group, of, offset = group[by], of[by], offset[by]
    lead = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.empty(0, bool)
    return of, offset, ~lead


def repeated_byte_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """spans(doc_id, tag, a, b): starts a..b (in bytes) of windows that also start earlier, by smaller doc_id or place.

    Segments meet by their anchor; those of crowded anchors are cut in two at most, which meet by their anchor and the bytes before or
    behind it; where these are crowded too, each window meets its equals by all its bytes. What a window meets by depends on the window
    alone. Blocks of them are decided by interval expansion; of a group that goes on beyond a block, the windows met so far go on with it,
    each once: these are at most those of CROWDED segments, however large the group."""
    spans, open_ = repeated(docs, byte_units, length, anchor, sides=True)
    crowd = written(open_.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("anchor", F.lit(True).alias("crowded")), "crowded")
    marked = open_.join(crowd, "anchor", "left")
    plain = marked.where("crowded is null").select(F.col("anchor").alias("key"), "doc_id", "tag", "a", "b", F.lit(False).alias("apart"))
    far, before = F.expr(f"int(sides & {(1 << FAR_BITS) - 1})"), F.expr(f"shiftrightunsigned(sides, {FAR_BITS + SIDE_BITS})")
    behind = F.expr(f"shiftrightunsigned(sides, {FAR_BITS}) & {(1 << SIDE_BITS) - 1}")
    halves = F.array(
        F.struct(F.xxhash64("anchor", F.lit(0), before).alias("key"), F.col("a").alias("a"), (F.col("a") + far - 1).alias("b")),
        F.struct(F.xxhash64("anchor", F.lit(1), behind).alias("key"), (F.col("a") + far).alias("a"), F.col("b").alias("b")),
    )
    parts = written(marked.where("crowded").select("doc_id", "tag", "others", F.explode(halves).alias("half")).select("half.*", "doc_id", "tag", "others").where("a <= b"), "parts")
    met = written(parts.groupBy("key").agg(F.count("*").alias("n"), F.max("others").alias("others")).where("n > 1 or others").select("key", (F.col("n") > CROWDED).alias("apart")), "met")
    asked = plain.union(parts.join(met, "key").select("key", "doc_id", "tag", "a", "b", "apart"))

    def cut(batch):
        out: list[list] = [[], [], [], [], []]
        for doc, tag, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for s in found:
                a, b, parts = s["a"], s["b"], [(s["key"], s["a"], s["b"])]
                if s["apart"]:
                    parts = [(k, i, i) for i, k in enumerate(run_at(doubled(byte_hashes(raw[a : b + length]), length), length).view(np.int64), a)]
                for k, lo, hi in parts:
                    for column, v in zip(out, (k, doc, tag, lo, raw[lo : hi + length]), strict=True):
                        column.append(v)
        return {c: pa.array(v, k) for c, v, k in zip(("key", "doc_id", "tag", "a", "payload"), out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)}

    def expand(batches):
        """Whole keys, in blocks of at least BLOCK_BYTES; rows are sorted by key, doc_id, tag and a."""
        held: list[tuple] = []
        size, last = 0, None

        def decided(goes_on):
            of, offset, later = window_order([r[4] for r in held], np.arange(len(held)), length)
            doc, tag, a = (np.array([r[i] for r in held], np.int64) for i in (1, 2, 3))
            gone = _spans(doc[of[later]], tag[of[later]], a[of[later]] + offset[later], a[of[later]] + offset[later])
            rest = []
            if goes_on is not None:  # first windows of the key that goes on, as runs of their segments
                mine = ~later & np.array([r[0] == goes_on for r in held])[of]
                of, offset = of[mine], offset[mine]
                by = np.lexsort((offset, of))
                of, offset = of[by], offset[by]
                edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)])[: len(of)])
                for lo, hi in zip(edge, np.append(edge[1:], len(of)), strict=False):
                    k, doc_, tag_, at, raw = held[of[lo]]
                    rest.append((k, doc_, tag_, at + int(offset[lo]), raw[offset[lo] : offset[hi - 1] + length]))
            return pa.RecordBatch.from_arrays([pa.array(gone[0], pa.int64()), *(pa.array(x, pa.int32()) for x in gone[1:])], names=["doc_id", "tag", "a", "b"]), rest

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[:4] == last:  # of a repeated row of documents
                    continue
                last = row[:4]
                if size >= BLOCK_BYTES:
                    found, held = decided(row[0])
                    yield found
                    size = 0  # what is carried does not count, so that each block takes as much that is new
                held.append(row)
                size += len(row[4])
        if held:
            yield decided(None)[0]

    cuts = map_arrow(with_text(docs, asked, "key", "a", "b", "apart"), cut, "key long, doc_id long, tag int, a int, payload binary", rows=128)
    expanded = cuts.repartition("key").sortWithinPartitions("key", "doc_id", "tag", "a").mapInArrow(expand, "doc_id long, tag int, a int, b int")
    found = written(spans.union(expanded), "byte-spans")
    for used in (spans, crowd, parts, met):
        removed(docs.sparkSession, used)
    return found


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) and the columns named by others, for each row of docs(doc_id, text).

    whole_characters: a removed run shrinks to whole UTF-8 characters, so that the rest is text. Null and empty texts have no bytes.
    Rows of a null doc_id are compared with nothing and keep all. Repeated rows are answered alike, as one; rows of one doc_id and
    different texts are different documents, in an order that their texts fix. Texts of any length are taken whole; an empty table
    gives no rows; no other columns are read."""

    def cut(batch):
        n, gone, runs, sha, kept = [], [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), span_arrays(batch.column(2)), strict=True):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            if spans is not None:
                out = covered(len(raw), spans, length)
                if whole_characters:  # a character goes if all of its bytes are covered
                    head = np.flatnonzero((raw & 0xC0) != 0x80)
                    whole = np.add.reduceat(~out, head) == 0 if len(head) else np.empty(0, bool)
                    out = np.repeat(whole, np.diff(np.append(head, len(raw))))
                edge = np.diff(np.concatenate([[0], out.view(np.int8)]))
                runs.append(int((edge == 1).sum()))
                gone.append(int(out.sum()))
                rest = raw[~out].tobytes()
            else:
                runs.append(0)
                gone.append(0)
                rest = raw.tobytes()
            n.append(len(raw))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        of = (n, gone, runs)
        return {"doc_id": batch.column(0)} | {c: batch.column(3 + i) for i, c in enumerate(others)} | {c: pa.array(v, pa.int64()) for c, v in zip(("n_bytes", "n_removed", "n_spans"), of, strict=True)} | {"kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())}

    spans = by_document(repeated_byte_spans(docs, length))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    carried = "".join(f"{c} {kinds[c]}, " for c in others)
    given = docs.select("doc_id", text_tag(), "text", *[F.col(c).alias(f"other_{i}") for i, c in enumerate(others)])
    asked = given.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans", *[f"other_{i}" for i in range(len(others))])
    return map_arrow(asked, cut, f"doc_id long, {carried}n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", rows=256)


def op10_interval_expansion_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")
