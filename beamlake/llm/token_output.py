"""Token-ID / binary output by Re-Pair grammar compression.

Shards of whole documents in ascending doc_id order. Per shard, frequent pairs of neighbouring ids are replaced by nonterminals,
round after round until none is left; the rules, the rounds' limits and the expansion length of every rule are stored, so a range of ids is decoded
without the rest of its shard. A shard is a row of a Parquet table: Spark's committer makes a lost task's shard appear once or not
at all, and any store that Spark can write will do."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import keep_freed, scratch, table
from beamlake.llm.tokens import tokenizer_path, word_ids

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Most ids of a shard (a longer document is a shard of its own), and the least count of a pair worth a rule.
SHARD_IDS, MIN_COUNT = 1 << 20, 6
SHARD = "part int, seq int, before long, n_docs long, n_ids long, base long, doc_ids binary, doc_lengths binary, symbols binary, rules binary, rounds binary, expansion binary"
_SPREAD = np.int64(-7046029254386353131)


def repair(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules of two symbols each, first rule of each round and the number of rules).

    A round counts neighbouring pairs, takes those found min_count times or more, resolves overlaps in favour of the more frequent pair
    (every other one along a chain of equals) and replaces them at once; rounds go on until no pair is that frequent. After the first
    round only pairs that are new or lost an overlap can qualify, so only their places are counted."""
    n = len(ids)
    x, after, before = np.append(ids.astype(np.int64), -1), np.arange(1, n + 2), np.arange(-1, n)
    alive, weight, rules, rounds, n_rules = np.ones(n + 1, bool), np.zeros(n + 1, np.int32), [np.empty((0, 2), np.int64)], [0], 0
    alive[n], at = False, np.arange(max(0, n - 1))
    while len(at) >= min_count:
        key = x[: n - 1] << 32 | x[1:n] if not n_rules else x[at] << 32 | x[after[at]]
        keys = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(edge, len(keys))).astype(np.int32)
        keys, count = keys[edge[count >= min_count]], count[count >= min_count]
        if not len(keys):
            break
        # a small table of the frequent pairs: of those that share a slot the most frequent stays, the rest wait for the next round
        order = np.argsort(count, kind="stable")
        keys, count, bits = keys[order], count[order], max(8, len(keys).bit_length() + 2)
        place = (keys * _SPREAD).view(np.uint64) >> np.uint64(64 - bits)
        table, crowded = np.full(1 << bits, -1, np.int32), np.bincount(place.view(np.int64), minlength=1 << bits) > 1
        table[place] = np.arange(len(keys), dtype=np.int32)
        slot = ((key * _SPREAD).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)
        which = table[slot]
        hit = keys[which] == key  # keys[-1] holds its slot, so an empty one (-1) is no hit
        held = at[crowded[slot] & ~hit]
        at, which = at[hit], which[hit]
        w = count[which]
        weight[at] = w
        best = (w >= weight[before[at]]) & (w >= weight[after[at]])
        weight[at] = 0
        here = at[best]
        start = np.concatenate([[True], before[here[1:]] != here[:-1]]) if len(here) else np.empty(0, bool)
        i = np.arange(len(here))
        best[best] = (i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0
        used = np.bincount(which[best], minlength=len(keys)) >= min_count
        best &= used[which]
        here = at[best]
        if not len(here):
            break
        number = np.cumsum(used) - 1
        rules.append(np.stack([keys[used] >> 32, keys[used] & 0xFFFFFFFF], axis=1))
        second = after[here]
        third = after[second]
        x[here], after[here], alive[second] = base + n_rules + number[which[best]], third, False
        before[third] = here
        n_rules += int(used.sum())
        rounds.append(n_rules)
        again = np.zeros(n + 1, bool)
        again[here] = again[before[here]] = again[at[~best]] = again[held] = True
        again &= alive
        again[n] = False
        at = np.flatnonzero(again)
        at = at[after[at] < n]
    return x[:n][alive[:n]], np.concatenate(rules), np.array(rounds, np.int64)


def expansion_lengths(rules: np.ndarray, rounds: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(rules), np.int64)
    length = lambda s: np.where(s < base, 1, out[np.maximum(s - base, 0)]) if len(out) else np.ones(len(s), np.int64)
    for lo, hi in zip(rounds[:-1], rounds[1:], strict=True):
        out[lo:hi] = length(rules[lo:hi, 0]) + length(rules[lo:hi, 1])
    return out


def _runs(table: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of the table one after another."""
    end = np.cumsum(length)
    return table[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - length), length)]


def expand(symbols: np.ndarray, rules: np.ndarray, rounds: np.ndarray, base: int) -> np.ndarray:
    """The ids of the symbols: every rule is written out once, round after round, then the symbols' runs are copied."""
    length = np.append(np.ones(base, np.int64), expansion_lengths(rules, rounds, base))
    start = np.cumsum(length) - length
    table = np.empty(int(length.sum()), np.int64)
    table[:base] = np.arange(base)
    for lo, hi in zip(rounds[:-1], rounds[1:], strict=True):
        pair = rules[lo:hi].ravel()
        part = _runs(table, start[pair], length[pair])
        table[start[base + lo] : start[base + lo] + len(part)] = part
    x = symbols.astype(np.int64)
    return _runs(table, start[x], length[x])


def shard_row(part: int, seq: int, before: int, doc_ids: list, encoded: list[bytes], base: int) -> list:
    ids = np.frombuffer(b"".join(encoded), "<u4")
    symbols, rules, rounds = repair(ids, base)
    return [part, seq, before, len(doc_ids), len(ids), base, pa.array(doc_ids, pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), (np.array([len(x) for x in encoded], "<i8") // 4).tobytes(), symbols.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), rounds.astype("<i8").tobytes(), expansion_lengths(rules, rounds, base).astype("<u4").tobytes()]


def shard_slice(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a shard, by the expansion lengths alone up to there."""
    base, symbols = row["base"], np.frombuffer(row["symbols"], "<u4").astype(np.int64)
    rules, rounds = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2), np.frombuffer(row["rounds"], "<i8")
    of_rule = np.frombuffer(row["expansion"], "<u4").astype(np.int64)
    size = np.where(symbols < base, 1, of_rule[np.maximum(symbols - base, 0)] if len(of_rule) else 1)
    end = np.cumsum(size)
    first, last = np.searchsorted(end, start, "right"), np.searchsorted(end, stop, "left")
    return expand(symbols[first : last + 1], rules, rounds, base)[start - (end[first] - size[first] if first < len(end) else 0) :][: stop - start]


def write_token_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the shards of docs(doc_id, text) to path, in ascending doc_id order over (part, seq).

    Null text: the end id alone. Null doc_id: first. Rows of one doc_id stand in any order. Very long texts: a shard of their own.
    An empty table: no shard. Other columns are not read."""
    file = tokenizer or tokenizer_path(TOKENIZER)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        from beamlake.llm.tokens import tokenizer as loaded

        keep_freed(16 << 20, 256 << 20)  # a shard's arrays are 8 MB each
        base, part, seq = loaded(file).get_vocab_size(), TaskContext.get().partitionId(), 0
        ids, parts, size, before = [], [], 0, 0
        names = [x.split()[0] for x in SHARD.split(", ")]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 6]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(shard_row(part, seq, before, ids, parts, base), kinds, strict=True)], names=names)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc, raw in zip(piece.column(0).to_pylist(), word_ids(piece.column(1).to_pylist(), file), strict=True):
                    n = len(raw) // 4 + 1
                    if ids and size + n > shard_ids:
                        yield row()
                        ids, parts, size, seq, before = [], [], 0, seq + 1, before + size
                    ids.append(doc)
                    parts.append(raw + end)
                    size += n
        if ids:
            yield row()

    docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id").mapInArrow(encode, SHARD).write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Part totals (as many as there are partitions) are summed on the driver; a shard holds its place in its part, so shards are read
    where they lie and travel to no other task."""
    shards = spark.read.schema(SHARD).parquet(path)
    parts = sorted((r["part"], r["n"]) for r in shards.select("part", "n_ids").groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    place, at = {}, 0
    for part, n in parts:
        place[part], at = at, at + n

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2), np.frombuffer(row["rounds"], "<i8"), row["base"])
                lengths, raw = np.frombuffer(row["doc_lengths"], "<i8"), ids.astype("<u4").tobytes()
                end = np.cumsum(lengths)
                begin = end - lengths
                docs = np.frombuffer(row["doc_ids"], "<i8")
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == np.iinfo(np.int64).min), pa.array(begin + row["before"] + place[row["part"]]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_repair_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-shards")
    write_token_shards(table(spark, sf_dir, "documents"), path)
    return read_token_shards(spark, path)
