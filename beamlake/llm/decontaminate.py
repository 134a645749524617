"""Benchmark decontamination by latent semantic retrieval.

TF-IDF over hashed words, a randomised SVD of passages whose sketch is summed over tasks, cosine search of every passage of every
document against the benchmark items in blocks, then the longest common subsequence and the item's answer (its last words) decide."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import U64, carried, map_arrow, mixed, one_blas_thread, removed, stretch_hashes, stretches, table, written

#: Hashed features, latent dimensions and columns of the sketch beyond them, words of a passage that is counted.
FEATURES, RANK, OVERSAMPLED, PASSAGE = 1 << 15, 64, 8, 64
#: Passage lengths; an item is sought in passages of the length nearest to its own, a quarter of it apart.
SCALES = (8, 16, 32, 64, 128, 256)
#: Least cosine of a candidate; share of an item's words in order that is a match by itself, or with its answer; the answer's part.
COSINE, CERTAIN, LIKELY, ANSWER, ANSWER_SHARE = 0.4, 0.8, 0.65, 0.25, 0.75
#: Features that travel together.
BLOCK = 512
#: Bytes of benchmark text that are broadcast and searched at once.
BLOCK_TEXT = 32 << 20
#: Words whose passages are searched at once.
CHUNK = 1 << 14
_MARKS = b".,;:!?\"'()[]|/-"
#: By byte: 0 part of a word, 1 a mark, 2 white space; and what it counts in a hash.
_KIND = np.zeros(256, np.uint8)
_KIND[list(_MARKS)] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 2
_VALUE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_state: dict = {}


def _piece_tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word."""
    kind = _KIND[raw]
    core = np.flatnonzero(kind == 0)
    if not len(core):
        return core, np.empty(0, U64)
    gap = np.flatnonzero(core[1:] - core[:-1] > 1)
    spaces = np.cumsum(kind == 2, dtype=np.int32)
    gap = gap[spaces[core[gap + 1]] > spaces[core[gap]]]  # marks alone do not part words
    first, last = core[np.append(0, gap + 1)], core[np.append(gap, len(core) - 1)]
    return first, mixed(stretch_hashes(raw, first, last + 1, _VALUE))


def tokens_of(texts: list[str | None]) -> list[np.ndarray]:
    """For each text its word hashes without marks around words; runs of marks alone give nothing. Long texts go piece by piece."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(raws).lower()
    every, places, hashed = np.frombuffer(raw, np.uint8), [np.empty(0, np.int64)], [np.empty(0, U64)]
    for at, end in stretches(raw, b" \n"):
        first, h = _piece_tokens(every[at:end])
        places.append(first + at)
        hashed.append(h)
    places, hashed = np.concatenate(places), np.concatenate(hashed)
    cut = np.searchsorted(places, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    return [hashed[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def tokens(text: str | None) -> np.ndarray:
    return tokens_of([text])[0]


def features(h: np.ndarray) -> np.ndarray:
    return (h >> U64(49)).astype(np.int64)


def common_subsequence(item: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Which of the item's words a longest common subsequence with the passage uses."""
    n, m = len(item), len(passage)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (passage == item[i])))
    used, i, j = np.zeros(n, bool), n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            used[i] = True
    return used


def common_length(item: np.ndarray, passage: np.ndarray) -> int:
    """Its length alone, by bit rows."""
    at: dict[int, int] = {}
    for j, w in enumerate(passage.tolist()):
        at[w] = at.get(w, 0) | 1 << j
    row = 0
    for w in item.tolist():
        hit = row | at.get(w, 0)
        row = hit & ~(hit - (row << 1 | 1))
    return row.bit_count()


def matches(item: np.ndarray, passage: np.ndarray) -> float:
    """The share of the item's words found in order, or 0 if that is no match."""
    share = common_length(item, passage) / len(item)
    if share < LIKELY:
        return 0.0
    if share >= CERTAIN:
        return share
    used = common_subsequence(item, passage)
    k = max(1, round(ANSWER * len(item)))
    return share if used[-k:].mean() >= ANSWER_SHARE else 0.0


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the tasks' (FEATURES x width) blocks, in two levels so that no group has more than a few dozen rows at once."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0] // 32], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0, dtype=np.float64).astype(np.float32)]})

    schema = "block int, part int, v array<float>"
    for _ in range(2):
        rows = rows.groupBy("block", F.expr("part div 32")).applyInPandas(add, schema)
    found = sorted(rows.groupBy("block").applyInPandas(add, schema).collect(), key=lambda r: r["block"])
    return np.concatenate([np.array(r["v"], np.float32).reshape(-1, width) for r in found]) if found else np.zeros((FEATURES + BLOCK, width), np.float32)


def _emit(matrix: np.ndarray):
    part = TaskContext.get().partitionId()
    blocks = len(matrix) // BLOCK
    v = matrix.astype(np.float32).reshape(blocks, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([part] * blocks, pa.int32()), pa.array(list(v), pa.list_(pa.float32()))], names=["block", "part", "v"])


def _occurrences(docs: list[np.ndarray], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, feature, times found) of every feature in every passage of the texts, and the number of passages."""
    length = np.array([len(f) for f in docs], np.int64)
    count = -(-length // size)
    end, first = np.cumsum(length), np.cumsum(count) - count
    place = np.arange(int(length.sum())) - np.repeat(end - length, length)
    key = np.sort((place // size + np.repeat(first, length)) << 16 | np.concatenate([*docs, np.empty(0, np.uint16)]).astype(np.int64))
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[edge] >> 16, key[edge] & 0xFFFF, np.diff(np.append(edge, len(key))), int(count.sum())


def _by_words(texts, most: int = 1 << 15):
    """Lists of feature arrays, each of some `most` words."""
    held, n = [], 0
    for f in texts:
        for at in range(0, len(f), most // PASSAGE * PASSAGE):
            held.append(f[at : at + most // PASSAGE * PASSAGE])
            n += len(held[-1])
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def decomposed(start: np.ndarray, product: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading singular vectors, singular values) of A from product = (A^T A) start, by the single-pass form of the randomised method:
    with start^T product = L L^T, product L^-T has the singular vectors of A, and values that are the squares of A's, nearly."""
    product = product.astype(np.float64)
    shift = 1e-7 * max(1e-12, float(np.linalg.norm(product)))
    small = start.T.astype(np.float64) @ (product + shift * start)
    root = np.linalg.cholesky((small + small.T) / 2 + 1e-12 * np.trace(small) * np.eye(len(small)))
    vectors, values, _ = np.linalg.svd(np.linalg.solve(root, (product + shift * start).T).T, full_matrices=False)
    return vectors[:, :rank], np.sqrt(np.maximum(values[:rank] ** 2 - shift, 0))


def fit(docs: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(idf by feature, weighted projection features x rank). Passage frequencies and the sketch (A^T A) R of the TF-IDF matrix A, with
    a few columns more than the rank, are gathered by feature block from all texts, whose features are written once."""
    schema, seed = "block int, part int, v array<float>", 11
    spark, width = docs.sparkSession, rank + OVERSAMPLED
    hashed = written(map_arrow(docs.select("text"), lambda batch: {"f": pa.array([features(h).astype(np.uint16).tobytes() for h in tokens_of(batch.column(0).to_pylist())], pa.binary())}, "f binary"), "features")
    texts = lambda batches: (np.frombuffer(f, np.uint16) for batch in batches for f in batch.column(0).to_pylist())

    def frequency(batches):
        df = np.zeros(FEATURES + BLOCK)  # then the number of passages
        for group in _by_words(texts(batches)):
            _, feature, _, n = _occurrences(group)
            df += np.bincount(feature, minlength=len(df))
            df[FEATURES] += n
        yield from _emit(df)

    counted = _summed(hashed.mapInArrow(frequency, schema), 1)[:, 0]
    df, n = counted[:FEATURES], float(counted[FEATURES])
    idf = (np.maximum(np.log((n + 10) / (df + 5)), 0) + 0.1).astype(np.float32)
    begin = lambda: np.random.default_rng(seed).normal(size=(FEATURES, width)).astype(np.float32)

    def product(groups) -> np.ndarray:
        start, out = begin(), np.zeros((FEATURES, width), np.float32)
        for group in groups:
            passage, feature, times, n = _occurrences(group)
            if not n:
                continue
            w = times * idf[feature]
            w = (w / np.sqrt(np.bincount(passage, w * w, n))[passage]).astype(np.float32)
            used, of = np.unique(feature.astype(np.uint16), return_inverse=True)
            part = np.zeros((n, len(used)), np.float32)  # these rows of A, the columns that they use
            part[passage, of] = w
            out[used] += part.T @ (part @ start[used])
        return out

    def sketch(batches):
        one_blas_thread()
        yield from _emit(product(_by_words(texts(batches), 1 << 12)))

    total = _summed(hashed.mapInArrow(sketch, schema), width)[:FEATURES]
    removed(spark, hashed)
    basis, _ = decomposed(begin(), total, rank)
    return idf, (idf[:, None] * basis).astype(np.float32)


def _held(vocabulary: np.ndarray, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which words (the last row is for all others) each item holds, and the words in order that are its least match."""
    held = np.zeros((len(vocabulary) + 1, len(items)), np.uint8)
    for i, h in enumerate(items):
        held[np.searchsorted(vocabulary, h), i] = 1
    size = np.array([len(h) for h in items])
    return held, np.stack([size, np.ceil(LIKELY * size - 1e-9).astype(np.int64)])


def _packed(held: np.ndarray, size: np.ndarray, need: np.ndarray, scale: int) -> list[tuple]:
    """Items in blocks of at most 1024 as (items, blocks on either side of a passage that count, held words as counters side by side in
    64-bit numbers, least counts). Whole numbers add up all their counters at once, as long as none can run over."""
    out, sides = [], 1 + -(-np.maximum(0, size - scale) // (scale // 4))
    for side in np.unique(sides).tolist():
        of_side = np.flatnonzero(sides == side)
        for first in range(0, len(of_side), 1024):
            own = of_side[first : first + 1024]
            lane = np.uint8 if (4 + 2 * side) * (scale // 4) < 255 else np.uint16
            width = -(-len(own) // 8) * 8
            counters, least = np.zeros((len(held), width), lane), np.full(width, np.iinfo(lane).max, lane)
            counters[:, : len(own)], least[: len(own)] = held[:, own], need[own]
            out.append((own, side, counters.view(np.uint64), least))
    return out


def _index(mark: str, shared):
    """Item vectors and words by passage length, made once in each worker."""
    if mark not in _state:
        one_blas_thread()
        _state.clear()
        items, projection = shared.value
        vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.empty(0, U64)
        projection = np.concatenate([projection, np.zeros((1, projection.shape[1]), np.float32)])
        by: dict[int, list] = {}
        for i, (_, h) in enumerate(items):
            by.setdefault(min(SCALES, key=lambda s: abs(np.log(s / len(h)))), []).append(i)
        unit = lambda v: v / max(1e-9, float(np.linalg.norm(v)))
        scales = {}
        for scale, k in by.items():
            held, (size, need) = _held(vocabulary, [items[i][1] for i in k])
            vectors = np.stack([unit(projection[features(items[i][1])].sum(0)) for i in k]).astype(np.float32)
            scales[scale] = np.array(k), vectors, held, size, need, _packed(held, size, need, scale)
        _state[mark] = items, projection, scales, vocabulary
    return _state[mark]


def _candidates(docs: list[np.ndarray], projection: np.ndarray, by: dict, vocabulary: np.ndarray):
    """(document, passage start, scale, item) wherever enough words are the item's and the cosine is COSINE or more.

    A common subsequence is no longer than the count of words near the passage that the item holds, so the count loses no match, and it
    is what is cheap: documents stand in one stream, each from a block's edge on, whose blocks of a quarter of a passage are counted for
    all items at once (words of a neighbour only raise a count). Vectors are made for the passages that are left."""
    widest = max(by)
    length = np.array([len(h) for h in docs], np.int64)
    room = -(-np.maximum(length, 1) // (widest // 4)) * (widest // 4)
    begin = np.cumsum(room) - room
    every = np.concatenate([*docs, np.empty(0, U64)])
    place = np.full(int(room.sum()), len(vocabulary))  # the last row of what items hold is empty
    found = np.searchsorted(vocabulary, every)
    found[vocabulary[np.minimum(found, len(vocabulary) - 1)] != every] = len(vocabulary)
    place[np.arange(len(every)) + np.repeat(begin - (np.cumsum(length) - length), length)] = found
    for scale, (which, vectors, held, size, need, packed) in by.items():
        step, blocks = scale // 4, len(place) // (scale // 4)
        distinct = held.sum(axis=0, dtype=np.int64)
        for own, side, counters, least in packed:  # the query set in blocks
            for at in range(0, blocks, CHUNK // step):
                rows = np.arange(at, min(blocks, at + CHUNK // step))
                first, last = max(0, at - side), min(blocks, int(rows[-1]) + 4 + side)
                count = np.zeros((last - first + 1, counters.shape[1]), np.uint64)  # sums may wrap around, their differences are right
                np.cumsum(counters[place[first * step : last * step]].reshape(last - first, step, -1).sum(axis=1), axis=0, out=count[1:])
                near = count[np.minimum(rows + 4 + side, last) - first] - count[np.maximum(rows - side, first) - first]
                row, item = np.divmod(np.flatnonzero(near.view(least.dtype) >= least), len(least))
                if not len(row):
                    continue
                start = rows[row] * step
                doc = np.searchsorted(begin, start, "right") - 1
                start -= begin[doc]
                real = start // step < np.maximum(1, -(-length[doc] // step) - 3)
                doc, start, item = doc[real], start[real], own[item[real]]
                # the words of just this document and just as near as this item needs: counted, then told apart
                more = scale // 4 + np.maximum(0, size[item] - scale)
                low, high = np.maximum(0, start - more) + begin[doc], np.minimum(length[doc], start + scale + more) + begin[doc]
                for test in (_words_enough, _distinct_enough):
                    enough = np.zeros(len(doc), bool)
                    for i in range(0, len(doc), 4096):
                        j = slice(i, i + 4096)
                        word = low[j, None] + np.arange(int((high[j] - low[j]).max()))
                        word = np.where(word < high[j, None], place[np.minimum(word, len(place) - 1)], len(vocabulary))
                        enough[j] = test(held, word, item[j], size, need, distinct)
                    doc, start, item, low, high = doc[enough], start[enough], item[enough], low[enough], high[enough]
                if not len(doc):
                    continue
                passages, of = np.unique(doc << 40 | start, return_inverse=True)
                v = np.stack([projection[features(docs[p >> 40][(p & (1 << 40) - 1) :][:scale])].sum(0) for p in passages.tolist()])
                norm = np.maximum(np.sqrt((v * v).sum(1)), 1e-9)
                alike = np.einsum("ij,ij->i", v[of], vectors[item]) >= COSINE * norm[of]
                yield from zip(doc[alike].tolist(), start[alike].tolist(), [scale] * int(alike.sum()), which[item[alike]].tolist(), strict=True)


def _words_enough(held, word, item, size, need, distinct) -> np.ndarray:
    """Whether the passage has as many words that the item holds as a match needs."""
    return held[word, item[:, None]].sum(axis=1, dtype=np.int32) >= need[item]


def _distinct_enough(held, word, item, size, need, distinct) -> np.ndarray:
    """Whether few enough of the item's distinct words are absent: each is a word less in common."""
    word = np.sort(word, axis=1)
    new = np.ones(word.shape, bool)
    new[:, 1:] = word[:, 1:] != word[:, :-1]
    there = (held[word, item[:, None]].astype(bool) & new).sum(axis=1)
    return size[item] - (distinct[item] - there) >= need[item]


def find_leaks(docs: list[np.ndarray], items: list, projection: np.ndarray, by: dict, vocabulary: np.ndarray) -> list[dict[int, float]]:
    """For each document the best share of each benchmark item that its words match."""
    found: list[dict[int, float]] = [{} for _ in docs]
    for doc, start, scale, k in _candidates(docs, projection, by, vocabulary):
        words = items[k][1]
        more = scale // 4 + max(0, len(words) - scale)
        passage = docs[doc][max(0, start - more) : start + scale + more]
        share = matches(words, passage)
        if share > found[doc].get(k, 0.0):
            found[doc][k] = share
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, others: tuple[str, ...] = (), block_bytes: int = BLOCK_TEXT) -> DataFrame:
    """(doc_id, item_ids, best_share, kept) and the columns in others for each row of docs(doc_id, text); benchmark has item_id and text.

    kept: no item was found. Null and empty texts match nothing; items without words are left out, items of one or two words match every
    text that has them; a null item_id is reported as null; repeated rows are answered alike. Texts are taken whole. The benchmark is the
    stated query set: its bytes are counted, and it is broadcast and searched in blocks of block_bytes. An empty one keeps all, an empty
    documents table gives no rows; columns beside these and others are not read."""
    spark, asked = docs.sparkSession, benchmark.select("item_id", "text").where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    projection = fit(docs.select("text").unionByName(asked.select("text")))[1] if size else np.zeros((FEATURES, RANK), np.float32)
    schema = "doc_id long, item_ids array<long>, best_share double, _searched string" + carried(docs, others)
    rows = docs.select("doc_id", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("best_share"), F.col("text").alias("_searched"), *others)
    for block in range(blocks if size else 0):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = [(r["item_id"], h) for r, h in zip(own, tokens_of([r["text"] for r in own]), strict=True) if len(h)]
        if items:
            rows = map_arrow(rows, _searching(uuid.uuid4().hex, spark.sparkContext.broadcast((items, projection)), others), schema, rows=128, text="_searched")
    return rows.select("doc_id", "item_ids", "best_share", (F.size("item_ids") == 0).alias("kept"), *others)


def _searching(mark: str, shared, others: tuple[str, ...]):
    def search(batch):
        items, projection, by, vocabulary = _index(mark, shared)
        found = find_leaks(tokens_of(batch.column(3).to_pylist()), items, projection, by, vocabulary)
        ids = [sorted([*had, *(items[k][0] for k in f)], key=lambda x: (x is not None, x)) for had, f in zip(batch.column(1).to_pylist(), found, strict=True)]
        best = [max([had, *f.values()]) for had, f in zip(batch.column(2).to_pylist(), found, strict=True)]
        return {"doc_id": batch.column(0), "item_ids": pa.array(ids, pa.list_(pa.int64())), "best_share": pa.array(best, pa.float64()), "_searched": batch.column(3)} | {c: batch.column(4 + i) for i, c in enumerate(others)}

    return search


def op8_latent_semantic_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.array_join("item_ids", ",").alias("item_ids"), "best_share", "kept")
