"""Where texts repeat: what the two substring operators share.

A window is `window` consecutive units of one document. Its anchor is the least (rightmost of equals) of its runs of `anchor` units,
which depends on the window alone, so equal windows have equal anchors: only anchors are gathered, a small share of all positions.
A segment is a run of windows with one anchor. Equal segments are one class, whose earliest segment stands for it, marked as having
others; the rest of a class repeats it. Each class that has others, or shares its anchor with another class, goes on to the operator's
own method, which decides every window of it. Where sides are asked for, a class without others goes on only if another class of its
anchor has the same units beside the anchor, on a side that windows of both cover: without that no window of it can be repeated.

Within the tables here a row of documents is known by its doc_id and a tag of its text, so rows of one doc_id and different texts are
different documents, in the order of their tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamlake.llm.base import U64, doubled, least_positions, mixed, run_at, sliced, text_hashes, written

_BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Units that are hashed at once (arrays of them fit a core's cache; longer texts go in overlapping stretches), and units that a task
#: sorts and classes by itself before it passes segments on.
STRETCH_UNITS, BUFFER_UNITS = 1 << 16, 1 << 23
#: A place is tag (22 bits), start (32), further windows (8) and whether the class has others (1).
_TAG_BITS, _SPAN = 22, 256
#: Sides are hashes of the units before and behind the anchor (27 bits each) and how many of the segment's windows, its first ones, are far:
#: they start so long before the anchor that they cover the units before it. The others cover those behind it.
SIDE_BITS, FAR_BITS = 27, 10
#: Classes of one anchor that are compared by their sides at once; an anchor with more of them passes all on.
GROUP = 8192


def byte_hashes(raw: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(raw, np.uint8)]


def byte_units(texts: list[str | None]) -> list[np.ndarray]:
    return [byte_hashes((t or "").encode("utf-8", "surrogatepass")) for t in texts]


def word_units(texts: list[str | None]) -> list[np.ndarray]:
    return text_hashes(texts, lower=False)


def text_tag() -> Column:
    return F.xxhash64("text").bitwiseAND(F.lit((1 << _TAG_BITS) - 1)).cast("int").alias("tag")


def segments(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, units: list[np.ndarray], window: int, anchor: int, sides: bool = False) -> np.ndarray:
    """Columns (anchor, segment, doc, place and, if asked for, sides) of stretches of documents; starts are the stretches' places in their
    documents."""
    size = np.array([len(u) for u in units])
    end = np.cumsum(size)
    begin = end - size
    steps = doubled(np.concatenate(units), window)
    runs = run_at(steps, anchor)
    at = least_positions(runs, window - anchor + 1)
    doc = np.repeat(np.arange(len(units)), size)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + window <= end[doc])
    if not len(start):
        return np.empty((4 + sides, 0), np.int64)
    at, doc = at[start], doc[start]
    edge = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    if window - anchor >= _SPAN:
        i = np.arange(len(start))
        edge |= (i - np.maximum.accumulate(np.where(edge, i, 0))) % _SPAN == 0
    first = start[edge]
    last = start[np.append(np.flatnonzero(edge)[1:] - 1, len(start) - 1)]
    place, of = at[edge], doc[edge]
    key = mixed(run_at(steps, window, first) + mixed(run_at(steps, window, last) + mixed((place - first).astype(U64) << U64(32) | (last - first).astype(U64))))
    where = tags[of] << 41 | (first - begin[of] + starts[of]) << 9 | (last - first) << 1
    columns = [runs[place].view(np.int64), key.view(np.int64), docs[of], where]
    return np.stack([*columns, _sides(steps, place, first, last, window, anchor)] if sides else columns)


def _sides(steps: dict[int, np.ndarray], place: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, anchor: int) -> np.ndarray:
    half = (window - anchor) // 2  # windows that start at most so long before the anchor are near
    far = np.clip(place - first - half, 0, last - first + 1)
    reach = min(anchor, half + 1, window - anchor - half)
    before = behind = np.zeros(len(place), U64)
    if reach > 0:
        few = U64(64 - SIDE_BITS)
        before = np.where(far > 0, run_at(steps, reach, np.maximum(place - reach, 0)) >> few, U64(0))
        behind = np.where(far <= last - first, run_at(steps, reach, np.minimum(place + anchor, len(steps[1]) - reach)) >> few, U64(0))
    return (before << U64(SIDE_BITS + FAR_BITS) | behind << U64(FAR_BITS) | far.astype(U64)).view(np.int64)


def _spans(doc: np.ndarray, tag: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching runs of window starts joined, by document."""
    order = np.lexsort((a, tag, doc))
    doc, tag, a, b = doc[order], tag[order], a[order], b[order]
    edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (a[1:] > b[:-1] + 1)]) if len(doc) else np.empty(0, bool)
    at = np.flatnonzero(edge)
    return doc[at], tag[at], a[at], np.maximum.reduceat(b, at) if len(at) else b


def _of_place(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tag, first window, last window)."""
    first = where >> 9 & 0xFFFFFFFF
    return where >> 41, first, first + (where >> 1 & 0xFF)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (anchor, segment, doc, place): the earliest of each class, marked if others follow, and the others."""
    new = np.concatenate([[True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])
    lead = np.flatnonzero(new)
    of = lead[np.cumsum(new) - 1]
    again = (x[2] != x[2, of]) | (x[3] >> 1 != x[3, of] >> 1)
    head = x[:, lead]
    head[3] |= np.maximum.reduceat(again | (x[3] & 1).astype(bool), lead)
    return head, x[:, again]


def _passed(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's segments: classes to pass on; repeats as spans, told by a negative place and dealt anywhere."""
    if not x.shape[1]:
        return
    head, again = _classes(x[:, np.lexsort((x[3], x[2], x[1], x[0]))])
    more = {"sides": head[4]} if len(x) > 4 else {}
    yield _batch(anchor=head[0], segment=head[1], doc_id=head[2], place=head[3], **more)
    if again.shape[1]:
        doc, tag, a, b = _spans(again[2], *_of_place(again[3]))
        yield _batch(anchor=mixed(doc.astype(U64) + a.astype(U64)).view(np.int64), segment=b, doc_id=doc, place=~(tag << 41 | a << 9), **{c: np.zeros_like(a) for c in more})


_ROW = "anchor long, segment long, doc_id long, place long"
_FOUND = "kind int, anchor long, doc_id long, tag int, a int, b int"


def _found(kind, anchor, doc, tag, a, b, *sides) -> pa.RecordBatch:
    return _batch(kind=kind.astype(np.int32), anchor=anchor, doc_id=doc, tag=tag.astype(np.int32), a=a.astype(np.int32), b=b.astype(np.int32), **dict(zip(("sides",), sides, strict=False)))


def _partnered(x: np.ndarray) -> np.ndarray:
    """Which classes have the same units before or behind the anchor as another class of it, where windows of both cover them."""
    side, far = x[4].view(U64), x[4] & (1 << FAR_BITS) - 1
    before, behind = np.flatnonzero(far > 0), np.flatnonzero(far <= (x[3] >> 1 & 0xFF))
    key = mixed(np.concatenate([side[before] >> U64(SIDE_BITS + FAR_BITS) << U64(1), (side[behind] >> U64(FAR_BITS) & U64((1 << SIDE_BITS) - 1)) << U64(1) | U64(1)]))
    of = np.concatenate([before, behind])
    key = mixed(key + x[0, of].view(U64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(x.shape[1], bool)
    out[of[order[1:][same]]] = out[of[order[:-1][same]]] = True
    return out


def settle(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, segment, doc_id, place): spans (kind 0), classes to decide, with others (kind 2) or without (kind 1).

    From batch to batch one class is kept, with sides all of the last anchor (GROUP of them at most): a hot anchor needs little more memory
    than any other."""
    held, opened = None, False
    for batch in _and_end(batches):
        x = held
        if batch is not None:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            span = x[3] < 0
            if span.any():
                tag, a, _ = _of_place(~x[3, span])
                yield _found(np.zeros(len(a)), x[0, span], x[2, span], tag, a, x[1, span], *x[4:, span])
            x = x[:, ~span] if held is None else np.concatenate([held, x[:, ~span]], axis=1)
        if x is None or not x.shape[1]:
            continue
        head, again = _classes(x)
        if again.shape[1]:
            doc, tag, a, b = _spans(again[2], *_of_place(again[3]))
            yield _found(np.zeros(len(a)), np.zeros(len(a), np.int64), doc, tag, a, b, *np.zeros((len(x) - 4, len(a)), np.int64))
        new = np.concatenate([[True], head[0, 1:] != head[0, :-1]])
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        several = np.bincount(group) > 1
        several[0] |= opened
        keep = (several | np.maximum.reduceat(head[3] & 1, at).astype(bool))[group]
        whole = np.full(len(at), len(x) > 4)  # anchors whose classes are all here, with sides
        whole[0] &= not opened
        if batch is not None:
            whole[-1] &= head.shape[1] - at[-1] <= GROUP
            back = at[-1] if whole[-1] else head.shape[1] - 1
            held, opened = head[:, back:], bool(several[-1]) and not whole[-1]
            keep[back:] = False
        if whole.any():
            keep &= ~whole[group] | (head[3] & 1).astype(bool) | _partnered(head)
        if keep.any():
            yield _found(1 + (head[3, keep] & 1), head[0, keep], head[2, keep], *_of_place(head[3, keep]), *head[4:, keep])


def _and_end(batches):
    yield from batches
    yield None


def repeated(docs: DataFrame, units: Callable[[list[str | None]], list[np.ndarray]], window: int, anchor: int, sides: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans, open): spans(doc_id, tag, a, b) are window starts known to repeat earlier windows; open(anchor, doc_id, tag, a, b,
    others and, if asked for, sides) has the earliest segment of each class that has others or shares its anchor (with sides: and the
    units beside it). Rows of null doc_id take no part."""
    more = ", sides long" if sides else ""

    def gather(batches):
        held, waiting, sizes = [], [], [0, 0]

        def hash_waiting():
            if waiting:
                doc, tag, start, u = zip(*waiting, strict=True)
                held.append(segments(np.array(doc, np.int64), np.array(tag, np.int64), np.array(start, np.int64), list(u), window, anchor, sides))
            waiting.clear()
            sizes[0] = 0

        for batch in batches:
            for piece in sliced(batch, 1, 256):
                for doc, u, tag in zip(piece.column(0).to_pylist(), units(piece.column(1).to_pylist()), piece.column(2).to_pylist(), strict=True):
                    for start in range(0, len(u) - window + 1, STRETCH_UNITS):
                        part = u[start : start + STRETCH_UNITS + window - 1]
                        waiting.append((doc, tag, start, part))
                        sizes[0] += len(part)
                        sizes[1] += len(part)
                        if sizes[0] >= STRETCH_UNITS:
                            hash_waiting()
                if sizes[1] >= BUFFER_UNITS:
                    hash_waiting()
                    yield from _passed(np.concatenate(held, axis=1))
                    held.clear()
                    sizes[1] = 0
        hash_waiting()
        if held:
            yield from _passed(np.concatenate(held, axis=1))

    long_enough = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= window)).select("doc_id", "text", text_tag())
    rows = long_enough.mapInArrow(gather, _ROW + more).repartition("anchor").sortWithinPartitions("anchor", "segment", "doc_id", "place")
    done = written(rows.mapInArrow(settle, _FOUND + more), "settled")
    return done.where("kind = 0").select("doc_id", "tag", "a", "b"), done.where("kind > 0").select("anchor", "doc_id", "tag", "a", "b", (F.col("kind") == 2).alias("others"), *["sides"] * sides)


def with_text(docs: DataFrame, open_: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, tag, text, found): each row of docs that has open segments, with structs of the columns (equal rows repeat them)."""
    asked = open_.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*columns)).alias("found"))
    texts = docs.where("doc_id is not null").select("doc_id", text_tag(), "text")
    return texts.join(asked, ["doc_id", "tag"])


def by_document(spans: DataFrame) -> DataFrame:
    """(doc_id, tag, spans): the spans of each document, at most as many as it has units."""
    return spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def span_arrays(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Starts and ends of each row's spans; None for no spans."""
    end, flat = column.offsets.to_numpy(), column.values
    a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    for i in range(len(column)):
        yield None if end[i] == end[i + 1] else (a[end[i] : end[i + 1]], b[end[i] : end[i + 1]])


def covered(n: int, spans: tuple[np.ndarray, np.ndarray] | None, window: int) -> np.ndarray:
    """Which of n units are in a window that starts in one of the spans."""
    if spans is None:
        return np.zeros(n, bool)
    step = np.bincount(spans[0], minlength=n + 1)[: n + 1] - np.bincount(np.minimum(spans[1] + window, n), minlength=n + 1)[: n + 1]
    return np.cumsum(step[:-1]) > 0
