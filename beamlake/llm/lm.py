"""LM scoring with a gated recurrent network in numpy.

Truncated back-propagation, an output softmax factored into word classes, and a hidden state that is carried from window to window, so
a document's log-likelihood is that of the whole text. Words outside the model's vocabulary share one symbol; its probability is
divided among them by smoothed counts, so the score is a proper log-probability of the text."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import U64, one_blas_thread, sliced, table, text_hashes, written

#: Vocabulary (with the two symbols below), classes of equal size, hidden units.
VOCABULARY, CLASSES, HIDDEN = 4096, 64, 16
UNKNOWN, END = 0, 1
#: Words whose counts are broadcast; the counts of the others are joined.
FREQUENT = 65_536
#: Documents of the starting model (one bounded task); then the tasks learn from all training documents, these again included.
SEED_DOCS = 1500
#: Lanes of a window (fewer for the starting model, which learns from little), its length, and the rate.
LANES, SEED_LANES, WINDOW, RATE = 256, 32, 24, 0.08
_END_HASH = U64(0x5EED0FE4D0000001)
_CHUNK = 8192
_state: dict = {}


def encoded(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words and of its end."""
    return [np.append(h, _END_HASH) for h in text_hashes(texts, lower=True)]


def _pieces(batches, column: int = 0, rows: int = 256):
    for batch in batches:
        yield from sliced(batch, column, rows)


class Lookup:
    """Numbers of 64-bit keys by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.keys, self.values = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
        mask = (1 << self.bits) - 1
        for i, k in enumerate(keys.tolist()):
            at = k >> 20 & mask
            while self.values[at] >= 0:
                at = at + 1 & mask
            self.keys[at], self.values[at] = k, i

    def __call__(self, h: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = (h >> U64(20)).astype(np.int64) & mask
        out = np.where(self.keys[at] == h, self.values[at], -1)
        todo = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & mask
            hit = self.keys[at[todo]] == h[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (self.values[at[todo]] >= 0)]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.tanh(x * np.float32(0.5))
    out *= np.float32(0.5)
    out += np.float32(0.5)
    return out


class Gru:
    """Word v belongs to class v // (VOCABULARY / CLASSES); numbers follow frequency."""

    shapes = {"x": (VOCABULARY, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (VOCABULARY, HIDDEN), "wb": (VOCABULARY,)}
    per_class = VOCABULARY // CLASSES

    def __init__(self, flat: np.ndarray | None = None):
        rng, at, self.p = np.random.default_rng(7), 0, {}
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            if flat is None:
                self.p[name] = (rng.normal(0, 0.1, shape) if len(shape) > 1 else np.zeros(shape)).astype(np.float32)
            else:
                self.p[name] = np.array(flat[at : at + n], np.float32).reshape(shape)
            at += n
        self.g = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes])

    def start_from(self, counts: np.ndarray) -> Gru:
        """Output biases from the words' counts: the first model is the unigram one."""
        per = np.maximum(counts, 0.5).reshape(CLASSES, -1)
        self.p["cb"] = np.log(per.sum(1) / per.sum()).astype(np.float32)
        self.p["wb"] = np.log(per / per.sum(1, keepdims=True)).ravel().astype(np.float32)
        return self

    def states(self, ids: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """(steps, lanes) inputs from state h: the state after each input and, if asked, what back-propagation needs."""
        u, H = self.p["u"], HIDDEN
        gates = self.p["x"][ids]
        gates += self.p["b"]
        out, kept = np.empty((*ids.shape, H), np.float32), []
        for t in range(len(ids)):
            hu = h @ u
            g = gates[t]
            g[:, : 2 * H] += hu[:, : 2 * H]
            rz = _sigmoid(g[:, : 2 * H])
            n = rz[:, :H] * hu[:, 2 * H :]
            n += g[:, 2 * H :]
            np.tanh(n, out=n)
            if keep:
                kept.append((h, rz, hu[:, 2 * H :], n))
            h = np.subtract(h, n, out=out[t])
            h *= rz[:, H:]
            h += n
        return out, kept

    def _overflow(self) -> bool:
        """Whether an output could leave the range of exp: states lie between -1 and 1."""
        return max(float((np.abs(self.p["c"]).sum(0) + np.abs(self.p["cb"])).max()), float((np.abs(self.p["w"]).sum(1) + np.abs(self.p["wb"])).max())) > 60

    def log_probs(self, h: np.ndarray, target: np.ndarray, learn: bool = False):
        """Natural log-probability of each target; with learn also the gradient at h and of the output parameters.

        Rows are sorted by class once, so that each class' rows are a slice."""
        per, N = self.per_class, len(h)
        order = np.argsort((target // per).astype(np.uint8 if CLASSES <= 256 else np.int32), kind="stable")
        h, target = h[order], target[order]
        c = target // per
        edge = np.searchsorted(c, np.arange(CLASSES + 1))
        one, clip = np.ones((N, 1), np.float32), self._overflow()
        h1 = np.concatenate([h, one], axis=1)  # biases are the weights of a last unit that is always 1
        e = h1 @ np.concatenate([self.p["c"], self.p["cb"][None]])
        if clip:
            np.minimum(e, 60, out=e)
        rows = np.arange(N)
        logs = e[rows, c]
        np.exp(e, out=e)
        total = e @ np.ones(CLASSES, np.float32)
        logs -= np.log(total)
        if learn:
            e *= (-1 / total)[:, None]
            e[rows, c] += 1
            both = h1.T @ e
            grad = {"c": both[:-1], "cb": both[-1], "w": np.zeros_like(self.p["w"]), "wb": np.zeros_like(self.p["wb"])}
            dh = e @ self.p["c"].T
        f, w1 = np.empty((N, per), np.float32), np.concatenate([self.p["w"], self.p["wb"][:, None]], axis=1)
        used = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
        for k in used:
            np.matmul(h1[edge[k] : edge[k + 1]], w1[k * per : (k + 1) * per].T, out=f[edge[k] : edge[k + 1]])
        if clip:
            np.minimum(f, 60, out=f)
        t = target - c * per
        logs += f[rows, t]
        np.exp(f, out=f)
        total = f @ np.ones(per, np.float32)
        logs -= np.log(total)
        out = np.empty(N, np.float32)
        out[order] = logs
        if not learn:
            return out
        f *= (-1 / total)[:, None]
        f[rows, t] += 1
        for k in used:
            part, own = f[edge[k] : edge[k + 1]], slice(k * per, (k + 1) * per)
            both = part.T @ h1[edge[k] : edge[k + 1]]
            grad["w"][own], grad["wb"][own] = both[:, :-1], both[:, -1]
            dh[edge[k] : edge[k + 1]] += part @ self.p["w"][own]
        back = np.empty_like(dh)
        back[order] = dh
        return out, back, grad

    def gradient(self, ids: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        """(gradient of the summed log-probability but for the input words, words used, their gradient, state to carry on)."""
        T, B, H, u = *ids.shape, HIDDEN, self.p["u"]
        out, kept = self.states(ids, h, keep=True)
        _, dh_out, grad = self.log_probs(out.reshape(-1, H), target.ravel(), learn=True)
        dh_out = dh_out.reshape(T, B, H)
        # what reaches the gates by the input, and by the state, where the candidate's part passes the reset gate
        dgate, dstate, dh = np.empty((T, B, 3 * H), np.float32), np.empty((T, B, 3 * H), np.float32), np.zeros((B, H), np.float32)
        for t in range(T - 1, -1, -1):
            before, rz, hu, n = kept[t]
            r, z = rz[:, :H], rz[:, H:]
            dh += dh_out[t]
            dn = dgate[t, :, 2 * H :]
            np.multiply(dh, (1 - z) * (1 - n * n), out=dn)
            dgate[t, :, H : 2 * H] = dh * (before - n) * z * (1 - z)
            dgate[t, :, :H] = dn * hu * r * (1 - r)
            dstate[t, :, : 2 * H] = dgate[t, :, : 2 * H]
            np.multiply(dn, r, out=dstate[t, :, 2 * H :])
            dh *= z
            dh += dstate[t] @ u.T
        before = np.stack([k[0] for k in kept]).reshape(-1, H)
        flat = dgate.reshape(-1, 3 * H)
        grad |= {"u": before.T @ dstate.reshape(-1, 3 * H), "b": flat.sum(0)}
        order = np.argsort(ids.ravel().astype(np.uint16 if VOCABULARY <= 1 << 16 else np.int32), kind="stable")
        word = ids.ravel()[order]
        edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return grad, word[edge], np.add.reduceat(flat[order], edge, axis=0), out[-1]

    def learn(self, ids: np.ndarray, target: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window of truncated back-propagation with Adagrad steps; the state to carry on."""
        grad, used, by_word, h = self.gradient(ids, target, h)
        scale = np.float32(1 / ids.shape[1])
        for k, d in grad.items():
            d *= scale
            np.clip(d, -1, 1, out=d)
            self.g[k] += d * d
            self.p[k] += RATE * d / np.sqrt(self.g[k])
        by_word *= scale
        np.clip(by_word, -1, 1, out=by_word)
        g = self.g["x"][used] + by_word * by_word
        self.g["x"][used] = g
        self.p["x"][used] += RATE * by_word / np.sqrt(g)
        return h

    def learn_stream(self, ids: np.ndarray, lanes: int = LANES) -> None:
        """Documents one after another, cut into lanes that are read side by side."""
        lanes = min(lanes, max(1, len(ids) // WINDOW))
        n = len(ids) // lanes
        if not n:
            return
        x = np.concatenate([[END], ids])[: lanes * n].reshape(lanes, n).T
        y = ids[: lanes * n].reshape(lanes, n).T
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, n, WINDOW):
            h = self.learn(x[t : t + WINDOW], y[t : t + WINDOW], h)

    def score(self, docs: list[np.ndarray], window: int = 32, lanes: int = 256) -> np.ndarray:
        """Log-probability (natural) of each document's ids, each ending in END, from the state after an END.

        Documents of like length are read side by side; a lane whose document has ended is dropped, so no text is padded."""
        out = np.zeros(len(docs))
        size = np.array([len(d) for d in docs])
        order = np.argsort(-size, kind="stable")
        for first in range(0, len(docs), lanes):
            group = order[first : first + lanes]
            length, h = size[group], np.zeros((len(group), HIDDEN), np.float32)
            before = np.full(len(group), END, np.int32)
            for t in range(0, int(length[0]), window):
                live = int(np.searchsorted(-length, -t, "left"))  # longer than t
                y = np.full((min(window, int(length[0]) - t), live), END, np.int32)
                for j, i in enumerate(group[:live]):
                    part = docs[i][t : t + window]
                    y[: len(part), j] = part
                states, _ = self.states(np.concatenate([before[None, :live], y[:-1]]), h[:live])
                h, before = states[-1], y[-1]
                real = np.arange(t, t + len(y))[:, None] < length[:live]
                lp = self.log_probs(states[real], y[real])
                out[group[:live]] += np.bincount(np.broadcast_to(np.arange(live), real.shape)[real], lp, live)
        return out


def _counted(docs: DataFrame) -> DataFrame:
    """(h, n): count of every token in docs."""

    def count(batches):
        keys, counts = np.empty(0, U64), np.empty(0, np.int64)
        held, size = [], 0

        def merged(keys, counts, more):
            k, n = np.unique(more, return_counts=True)
            every = np.concatenate([keys, k])
            order = np.argsort(every, kind="stable")
            every, n = every[order], np.concatenate([counts, n])[order]
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            return every[edge], np.add.reduceat(n, edge)

        out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])
        for piece in _pieces(batches):
            for h in encoded(piece.column(0).to_pylist()):
                held.append(h)
                size += len(held[-1])
                if size > 1 << 20:
                    keys, counts = merged(keys, counts, np.concatenate(held))
                    held, size = [], 0
                    if len(keys) > 2_000_000:
                        yield out(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        if held:
            keys, counts = merged(keys, counts, np.concatenate(held))
        if len(keys):
            yield out(keys, counts)

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The commonest words, `most` at most: all from the least count on that leaves so few. No task or driver sorts more than these:
    the bound is read off a histogram of counts (whole numbers, then steps of 1/64 of an octave: under 5,000 of them)."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("long")
    bound, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        bound = r["step"]
    return counts.where(F.lit(False) if bound is None else step >= bound)


def _ready(mark: str, shared):
    if mark not in _state:
        one_blas_thread()
        _state.clear()
        keys, counts, flat = shared.value
        _state[mark] = Lookup(keys), counts, Gru(flat)
    return _state[mark]


def _ids(found: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Model ids of looked-up numbers: the END is 1, the commonest words follow, all others are unknown."""
    return np.where(h == _END_HASH, END, np.where((found >= 0) & (found < VOCABULARY - 2), found + 2, UNKNOWN)).astype(np.int32)


def _averaged(parts: DataFrame) -> np.ndarray:
    """Mean of the tasks' parameters, weighted by tokens, in two levels of at most a few dozen rows a group."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["tokens"].to_numpy(np.float64)
        v = np.stack(pdf["v"].to_list()).astype(np.float64)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [pdf["part"].iloc[0] // 32], "tokens": [w.sum()], "v": [(v * w[:, None]).sum(0).astype(np.float32) / np.float32(w.sum())]})

    schema = "chunk int, part int, tokens double, v array<float>"
    for _ in range(3):  # 32^3 tasks; the last level is exact for more, only larger
        parts = parts.groupBy("chunk", F.expr("part div 32")).applyInPandas(mean, schema)
    rows = sorted((r for r in parts.groupBy("chunk").applyInPandas(mean, schema).collect()), key=lambda r: r["chunk"])
    return np.concatenate([np.array(r["v"], np.float32) for r in rows]) if rows else np.empty(0, np.float32)


def score_documents(docs: DataFrame, seed_docs: int = SEED_DOCS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text).

    Null and empty texts are their end alone. A null doc_id is not held out. Repeated rows are answered alike and count each in
    training. Texts are taken whole; an empty table gives no rows; without training documents every token is unknown to the
    base and the model keeps its start. Other columns are not read."""
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", fold.alias("held_out"), "text")
    training = docs.where("not held_out")
    counts = written(_counted(training), "counts")
    N, V = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    end = U64(_END_HASH).view(np.int64)
    top = sorted(_frequent(counts.where(F.col("h") != int(end))).collect(), key=lambda r: (-r["n"], r["h"]))
    keys, freq = np.array([r["h"] for r in top], np.int64).view(U64), np.array([r["n"] for r in top], np.int64)
    n_end = N - (counts.where(F.col("h") != int(end)).agg(F.sum("n")).first()[0] or 0)
    inside = freq[: VOCABULARY - 2]
    unknown_n, unknown_v = N - int(inside.sum()) - n_end, V - len(inside) - bool(n_end)
    model_counts = np.zeros(VOCABULARY)
    model_counts[:2], model_counts[2 : 2 + len(inside)] = (unknown_n, n_end), inside

    def train(mark, shared, passes, lanes):
        def run(batches):
            lookup, _, model = _ready(mark, shared)
            model, stream, size, tokens = Gru(model.flat()), [], 0, 0
            for piece in _pieces(batches):
                for h in encoded(piece.column(0).to_pylist()):
                    stream.append(_ids(lookup(h), h))
                    size += len(h)
                    if size > 1 << 19:
                        for _ in range(passes):
                            model.learn_stream(np.concatenate(stream), lanes)
                        tokens, stream, size = tokens + size, [], 0
            if stream:
                for _ in range(passes):
                    model.learn_stream(np.concatenate(stream), lanes)
                tokens += size
            if tokens:
                flat, part = model.flat(), TaskContext.get().partitionId()
                chunks = [flat[i : i + _CHUNK] for i in range(0, len(flat), _CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([part] * len(chunks), pa.int32()), pa.array([float(tokens)] * len(chunks)), pa.array(chunks, pa.list_(pa.float32()))], names=["chunk", "part", "tokens", "v"])

        return run

    schema, context = "chunk int, part int, tokens double, v array<float>", spark.sparkContext
    flat = Gru().start_from(model_counts).flat()
    first = training.where("doc_id is not null").withColumn("turn", F.xxhash64("doc_id")).select("turn", "doc_id").orderBy("turn", "doc_id").limit(seed_docs)
    seed = training.join(F.broadcast(first.select("doc_id").distinct()), "doc_id", "left_semi").select("text").repartition(1)  # at most seed_docs ids
    later = training.select("text")
    for data, passes, lanes in ((seed, 2, SEED_LANES), (later, 1, LANES)):
        found = _averaged(data.mapInArrow(train(uuid.uuid4().hex, context.broadcast((keys, freq, flat)), passes, lanes), schema))
        flat = found if len(found) else flat
    mark, shared, total = uuid.uuid4().hex, context.broadcast((keys, freq, flat)), float(np.log10(N + V + 1))
    of_unknown = float(np.log10(unknown_n + unknown_v + 1))

    def score(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in sliced(batch, 2, 2048):
                lookup, freq, model = _ready(mark, shared)
                ids, rows = [], []
                for h in encoded(piece.column(2).to_pylist()):
                    found = lookup(h)
                    v = _ids(found, h)
                    ids.append(v)
                    rare = h[(found < 0) & (v != END)]
                    logs = np.log10(freq[found[found >= 0]] + 1.0)
                    base = float(logs.sum() + np.log10(n_end + 1.0)) - len(h) * total
                    outside = found[(found >= VOCABULARY - 2)]
                    model_part = float(np.log10(freq[outside] + 1.0).sum()) - int((v == UNKNOWN).sum()) * of_unknown
                    rows.append((len(h), len(h) - len(rare) - (0 if n_end else 1), base, model_part, rare.view(np.int64)))
                lp = model.score(ids) / np.log(10)
                number = np.arange(at, at + piece.num_rows) + (part << 40)
                at += piece.num_rows
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), piece.column(0), piece.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(np.array(cols[3]) + lp), pa.array(cols[4], pa.list_(pa.int64()))], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"])

    scored = written(docs.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("h")).join(counts, "h").groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    more = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(rare, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(N)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def op6_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
