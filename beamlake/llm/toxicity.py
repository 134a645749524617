"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashed slots of its words, its pairs of neighbours and its pairs with one or two words left
out. Every slot has a rate of its own; the L1 term leaves few weights, which are broadcast (at most SLOTS of them)."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import U64, carried, hashes, map_arrow, table, words_of

BITS = 20
SLOTS = 1 << BITS
#: Labelled rows that the model is fitted on at most (chosen by a hash of doc_id), passes over them, and the FTRL parameters.
TRAINING_ROWS, PASSES = 12_000, 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.2
_GRAMS = ((0, 0x9E3779B97F4A7C15), (1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F), (3, 0xE7037ED1A0B428DB))
_MARKS = b".,;:!?\"'()[]|"
_models: dict = {}


def slots(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the slot of every gram, with repeats: words without marks around them, pairs next to each other or one or two apart."""
    every = []
    for text in texts:
        h = hashes([w.strip(_MARKS) for w in words_of(text, lower=True)])
        out = [(h * U64(_GRAMS[0][1]))]
        out += [h[:-d] * U64(salt) + h[d:] * U64(salt ^ 0x5851F42D4C957F2C | 1) for d, salt in _GRAMS[1:] if len(h) > d]
        every.append((np.concatenate(out) >> U64(64 - BITS)).astype(np.int32))
    return every


class Ftrl:
    def __init__(self, prior: float):
        self.z, self.n = np.zeros(SLOTS), np.zeros(SLOTS)
        self.bias = float(np.log(prior / (1 - prior)))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def training_labels(labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, label, turn) of at most `rows` labelled documents outside the held-out fold."""
    known = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, passes: int = PASSES) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, slots, weights). One task takes the bounded sample in the order of a hash, so a run can be repeated exactly; rows come pass
    after pass and are forgotten once learnt, so that long texts take no more memory than short ones."""

    def grams(batch):
        return {"turn": batch.column(0), "label": batch.column(1), "slots": pa.array([np.unique(s) for s in slots(batch.column(2).to_pylist())], pa.list_(pa.int32()))}

    chosen = training_labels(labels, rows)
    toxic, known = (x or 0 for x in chosen.agg(F.sum("label"), F.count("*")).first())

    def learn(batches):
        model = Ftrl((toxic + 0.5) / (known + 10))
        for batch in batches:
            for y, at in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                model.learn(at.values.to_numpy(), y)
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([kept.astype(np.int32)], pa.list_(pa.int32())), pa.array([w[kept].astype(np.float32)], pa.list_(pa.float32()))], names=["bias", "at", "w"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("turn", "label", "text")  # at most `rows` small rows
    ready = map_arrow(sample, grams, "turn long, label int, slots array<int>", rows=64)
    turns = ready.select("turn", "label", "slots", F.explode(F.array(*map(F.lit, range(passes)))).alias("pass"))
    r = turns.repartition(1).sortWithinPartitions("pass", "turn", F.xxhash64("slots")).mapInArrow(learn, "bias double, at array<int>, w array<float>").first()
    if r is None:  # no task ran: there is nothing to learn from
        return Ftrl(0.05).bias, np.empty(0, np.int64), np.empty(0, np.float32)
    return r["bias"], np.array(r["at"], np.int64), np.array(r["w"], np.float32)


def dense(mark: str, shared) -> tuple[float, np.ndarray]:
    if mark not in _models:
        bias, at, w = shared.value
        _models.clear()
        _models[mark] = bias, np.zeros(SLOTS, np.float32)
        _models[mark][1][at] = w
    return _models[mark]


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, passes: int = PASSES, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the columns in others for each row of docs(doc_id, text); labels has doc_id and toxic.

    Null and empty texts get the bias' score. A null doc_id is not held out. Repeated rows are answered alike; null labels teach nothing;
    without labels the prior of 1/20 is all. Long texts are taken whole; an empty table gives no rows; columns beside these and others are not read."""
    model = fit(docs, labels, rows, passes)
    mark, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        bias, weight = dense(mark, shared)
        out = []
        for at in slots(batch.column(2).to_pylist()):
            at = np.unique(at[weight[at] != 0])
            out.append(float(1 / (1 + np.exp(-np.clip(weight[at].sum(dtype=np.float64) + bias, -35, 35)))))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(out, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in out], pa.int32())} | {c: batch.column(3 + i) for i, c in enumerate(others)}

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    taken = docs.select("doc_id", fold.alias("held_out"), "text", *others)
    return map_arrow(taken, score, "doc_id long, held_out boolean, score double, predicted int" + carried(docs, others))


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
