"""Best-fit packing with large-item matching.

Lengths are whole numbers up to the capacity, so the packing is planned on the histogram of lengths (at most `capacity` numbers on
the driver, whatever the corpus). Items above a third of the capacity stand at most two in a sequence: the largest is matched with
the largest that still fits. Shorter ones, longest first, go to the fullest sequence with room (best fit). The plan maps ranks
within a length to (sequence, offset); executors look their pieces up in it."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamlake.llm.base import map_arrow, table, written
from beamlake.llm.tokens import tokenizer_path, word_ids

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 0, 2048
#: Pieces of one length that are ranked together, so that a common length is as many tasks as it needs.
RANKED = 1 << 16
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, items of this length in each, offset of the first)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rank, events, next_sequence = np.zeros(capacity + 1, np.int64), [], 0
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first sequence, sequences)

    def put(length: int, items: int, sequence: int, each: int, offset: int) -> None:
        events.append((length, rank[length], rank[length] + items, sequence, each, offset))
        rank[length] += items
        left[length] -= items

    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b > third and not left[b]:
                b -= 1
            if b <= third:
                n, gap = int(left[a]), capacity - a
                put(a, n, next_sequence, 1, 0)
            elif b == a:
                n, gap = int(left[a]) // 2, capacity - 2 * a
                if not n:
                    b -= 1
                    continue
                put(a, 2 * n, next_sequence, 2, 0)
            else:
                n, gap = int(min(left[a], left[b])), capacity - a - b
                put(a, n, next_sequence, 1, 0)
                put(b, n, next_sequence, 1, a)
            open_[gap].append((next_sequence, n))
            next_sequence += n
    for length in range(third, 0, -1):
        gap = length
        while left[length]:
            while gap <= capacity and not open_[gap]:
                gap += 1
            if gap > capacity:
                n = -(-int(left[length]) // (capacity // length))
                open_[capacity].append((next_sequence, n))
                next_sequence += n
                gap = capacity
            first, n = open_[gap].pop()
            each = gap // length
            full, more = divmod(min(int(left[length]), each * n), each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                open_[gap - each * length].append((first, full))
            if more:
                put(length, more, first + full, more, capacity - gap)
                open_[gap - more * length].append((first + full, 1))
            rest = full + bool(more)
            if rest < n:
                open_[gap].append((first + rest, n - rest))
    return np.array(sorted(events), np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    file, end = tokenizer or tokenizer_path(TOKENIZER), np.array([end_id], "<u4").tobytes()

    def cut(batch):
        out: list[list] = [[], [], [], [], []]
        for doc, raw in zip(batch.column(0).to_pylist(), word_ids(batch.column(1).to_pylist(), file), strict=True):
            raw += end
            for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                for column, v in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return {n: pa.array(c, k) for n, c, k in zip(("doc_id", "piece", "start", "length", "ids_crc32"), out, kinds, strict=True)}

    return map_arrow(docs.select("doc_id", "text"), cut, PIECE)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: the end id alone. Null doc_id: packed like any other. Repeated rows: each is packed. Very long texts: cut
    into pieces of `capacity`. An empty table: no rows. Other columns are not read."""
    cut = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    total = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    parts = docs.sparkSession.createDataFrame([(length, -(-n // RANKED)) for length, n in total.items()], "length long, parts int")
    dealt = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts").cast("int"))
    counted = dealt.groupBy("length", "part").count().collect()  # at most capacity + pieces / RANKED rows
    first_part = np.zeros(capacity + 2, np.int64)
    for length, n in total.items():
        first_part[length + 1] = -(-n // RANKED)
    first_part = np.cumsum(first_part)
    offsets, sizes = np.zeros(int(first_part[-1]), np.int64), np.zeros(int(first_part[-1]), np.int64)
    for r in counted:
        sizes[first_part[r["length"]] + r["part"]] = r["count"]
    for length in total:
        own = sizes[first_part[length] : first_part[length + 1]]
        offsets[first_part[length] : first_part[length + 1]] = np.cumsum(own) - own
    events = plan(total, capacity)
    shared = docs.sparkSession.sparkContext.broadcast((first_part, offsets, events))

    def place(batch):
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        first_part, offsets, events = shared.value
        length = get("length")
        rank = offsets[first_part[length] + get("part")] + get("n") - 1
        key = events[:, 0] << 44 | events[:, 1]
        e = events[np.searchsorted(key, length << 44 | rank, "right") - 1]
        k = rank - e[:, 1]
        return {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": e[:, 3] + k // e[:, 4], "offset": e[:, 5] + k % e[:, 4] * length}

    ranked = dealt.withColumn("n", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")).cast("long"))
    return map_arrow(ranked.drop("parts"), place, PIECE + ", sequence_id long, offset long", rows=1 << 16)


def op3_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
