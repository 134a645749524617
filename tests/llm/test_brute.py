"""Trained and planned operators against plain versions of the same method, and measured recall."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from beamlake.llm import decontaminate, lm, near_dedup, packing, quality, toxicity
from beamlake.llm.tokens import WordCache, tokenizer_path, word_ids

rnd = random.Random(21)


def _text(n, words=300):
    return " ".join(f"word{rnd.randrange(words)}" for _ in range(n))


def test_cached_tokens_equal_the_library(monkeypatch):
    """Marks, contractions, digits, combining and unusual characters; a cache that overflows all the time."""
    from beamlake.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    path = tokenizer_path("word_bpe_49k.json")
    t, alphabet = Tokenizer.from_file(path), "abIKİßẞÀéœŒñǅ'sSreL.,;:!?&*#$%-_09²½̱́̇\t ​中ا΄Σς <|>\n\"()"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + [None, "", "x" * 70000 + " It's 5!", "<|endoftext|> a"]
    tokens.forget_words()
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast([x or "" for x in part], add_special_tokens=False)] == word_ids(part, path)
    tokens.forget_words()
    assert isinstance(WordCache(path).ends, np.ndarray)


def test_ftrl_equals_a_plain_loop(spark):
    rows = [(i, _text(30) + (" vile filth" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    order = [(r["doc_id"], r["label"]) for r in toxicity.training_labels(labels).orderBy("turn").collect()]
    text, z, n = dict((i, t) for i, t, _ in rows), Counter(), Counter()
    bias = np.log((p := (sum(y for _, y in order) + 0.5) / (len(order) + 10)) / (1 - p))
    of = lambda d: set(toxicity.slots([text[d]])[0].tolist())

    def weight(k):
        return 0.0 if abs(z[k]) <= toxicity.L1 else -(z[k] - np.sign(z[k]) * toxicity.L1) / ((toxicity.BETA + np.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for d, y in order:
            w = {k: weight(k) for k in of(d)}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            for k, v in w.items():
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / toxicity.ALPHA * v
                n[k] += g * g
    for d in text:
        assert abs(got[d] - 1 / (1 + np.exp(-(sum(weight(k) for k in of(d)) + bias)))) < 1e-4
    assert not any(zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in order)


@pytest.mark.parametrize("ranked", [1 << 16, 3])
def test_packing_whole(spark, monkeypatch, ranked):
    """Every id once, in place; as few sequences as plain best fit of the same items with large ones matched."""
    monkeypatch.setattr(packing, "RANKED", ranked)
    texts = [_text(rnd.choice([3, 9, 20, 45, 60, 130])) for _ in range(120)] + [None, "", _text(3), _text(3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    capacity, t = 64, Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    want = Counter((i, k // capacity, k, len(part := v[k : k + capacity]), zlib.crc32(np.array(part, "<u4").tobytes())) for i, v in ids.items() for k in range(0, len(v), capacity))
    rows = packing.pack(docs, capacity=capacity).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts)[:-1], sorted(parts)[1:], strict=True)) and min(parts)[0] == 0 and sum(n for _, n in parts) <= capacity
    sizes = sorted((r["length"] for r in rows), reverse=True)
    gaps = []
    for n in sizes:  # best fit, longest first
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    assert -(-sum(sizes) // capacity) <= len(by) <= len(gaps) + 1


def test_lm_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    g = lm.Gru()
    for k in g.p:  # in double precision, away from the start
        g.p[k] = g.p[k].astype(np.float64) + rng.normal(0, 0.05, g.p[k].shape)
    T, B = 5, 3
    ids, target = rng.integers(0, 60, (T, B)).astype(np.int32), rng.integers(0, lm.VOCABULARY, (T, B)).astype(np.int32)
    h = rng.uniform(-0.5, 0.5, (B, lm.HIDDEN))

    def total():
        out, _ = slow_states(g, ids, h)
        return sum(slow_log_prob(g, out[t, b], target[t, b]) for t in range(T) for b in range(B))

    grad, used, by_word, _ = g.gradient(ids, target, h)
    checks = [(k, tuple(rng.integers(0, s) for s in g.p[k].shape)) for k in ("u", "b", "c", "cb") for _ in range(4)]
    checks += [("w", (int(target[0, 0]), 2)), ("wb", (int(target[1, 1]),)), ("x", (int(ids[0, 0]), 1)), ("x", (int(ids[2, 1]), lm.HIDDEN + 1)), ("x", (int(ids[3, 2]), 2 * lm.HIDDEN + 2))]
    for k, at in checks:
        was = g.p[k][at]
        g.p[k][at] = was + 1e-4
        up = total()
        g.p[k][at] = was - 1e-4
        down = total()
        g.p[k][at] = was
        have = by_word[np.searchsorted(used, at[0]), at[1]] if k == "x" else grad[k][at]
        assert abs(have - (up - down) / 2e-4) < 2e-3 * max(1, abs(have)), (k, at, have, (up - down) / 2e-4)


def slow_states(g, ids, h):
    H, sig, out, h = lm.HIDDEN, lambda v: 1 / (1 + np.exp(-v)), np.empty((*ids.shape, lm.HIDDEN)), np.array(h, float)
    for t in range(ids.shape[0]):
        for b in range(ids.shape[1]):
            x, u = g.p["x"][ids[t, b]] + g.p["b"], h[b] @ g.p["u"]
            r, z = sig(x[:H] + u[:H]), sig(x[H : 2 * H] + u[H : 2 * H])
            n = np.tanh(x[2 * H :] + r * u[2 * H :])
            h[b] = out[t, b] = (1 - z) * n + z * h[b]
    return out, h


def slow_log_prob(g, h, v):
    soft = lambda a, i: a[i] - np.log(np.exp(a - a.max()).sum()) - a.max()
    c, per = v // g.per_class, g.per_class
    own = slice(c * per, (c + 1) * per)
    return soft(h @ g.p["c"] + g.p["cb"], c) + soft(g.p["w"][own] @ h + g.p["wb"][own], v - c * per)


def test_lm_score_equals_a_plain_loop_and_beats_the_base(spark, monkeypatch):
    """Scores of some documents word by word with the trained network; on sentences with an order it beats word frequencies out of sample."""
    kept = {}
    plain = lm.Gru

    class Watched(plain):
        def score(self, docs, **k):
            kept["model"] = self
            return super().score(docs, **k)

    chain = lambda: " ".join(f"a{j % 7} b{(3 * j) % 5}" for j in range(rnd.randrange(5, 60)))
    docs = spark.createDataFrame([(i, chain()) for i in range(400)], "doc_id long, text string")
    rows = lm.score_documents(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    g = Watched()
    ids = [np.append(np.random.default_rng(i).integers(2, 90, 10 + 40 * i), lm.END).astype(np.int32) for i in range(3)]
    for one, got in zip(ids, g.score(ids, window=7), strict=True):
        out, _ = slow_states(g, np.append(lm.END, one[:-1])[:, None], np.zeros((1, lm.HIDDEN)))
        assert abs(got - sum(slow_log_prob(g, out[t, 0], one[t]) for t in range(len(one)))) < 1e-2


def test_frequent_words_are_all_from_a_count_on(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 30 + [5000] * 3 + [5001, 9000])], "h long, n long")
    got = sorted(r["n"] for r in lm._frequent(counts, 20).collect())
    assert got == [5000, 5000, 5000, 5001, 9000] and lm._frequent(counts, 2).count() == 1 and lm._frequent(counts, 100).count() == 85


def test_covariance_equals_plain_concentration(spark):
    """One group in numpy: medians, then steps of covering the closest three quarters."""
    names, k = list(quality.FEATURES), len(quality.FEATURES)
    rng = np.random.default_rng(2)
    texts = [" ".join(w + "#" * (rnd.random() < 0.03) for w in _text(rnd.randrange(60, 400)).split()) + ("\nsame\nsame" if rnd.random() < 0.3 else "") for _ in range(301)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    data = [r for r in quality.statistics(docs).orderBy("doc_id").collect() if not r["base_failed"]]
    x = np.array([[r[f] for f in names] for r in data])
    env = {"n_words": np.array([r["n_words"] for r in data], float), "word_chars": np.array([r["word_chars"] for r in data], float), "n_lines": np.array([r["n_lines"] for r in data], float), "sqrt": np.sqrt}
    at = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    floors = np.array([at(eval(e, env), 0.5) for e in quality.FEATURES.values()])
    centre = np.array([at(v, 0.5) for v in x.T])
    precision, usual = np.diag(1 / np.maximum([1.4826 * at(np.abs(v - c), 0.5) for v, c in zip(x.T, centre, strict=True)], floors) ** 2), 4.351
    for _ in range(quality.STEPS):
        d2 = np.einsum("ni,ij,nj->n", x - centre, precision, x - centre)
        inside = x[d2 <= at(d2, quality.COVERED)]
        centre, cov = inside.mean(0), np.cov(inside.T, bias=True)
        free = max(1.0, np.minimum(1, np.diag(cov) / floors**2).sum())
        var = np.maximum(np.diag(cov), floors**2)
        scale = np.sqrt(var / np.maximum(np.diag(cov), 1e-18))
        cov = np.where(np.eye(k, dtype=bool), var, cov / np.sqrt(np.outer(scale, scale)) * 0.95)
        precision, usual = np.linalg.pinv(cov, hermitian=True), free * (1 - 2 / (9 * free)) ** 3
    d2, n = np.einsum("ni,ij,nj->n", x - centre, precision, x - centre), len(x)
    want = d2 / (max(1.0, at(d2, 0.5) / usual) * max(1.0, (n + 1) * (n - 1) / (n * (n - k))))
    got = {r["doc_id"]: r["distance"] for r in quality.quality(docs).collect()}
    assert np.allclose([got[r["doc_id"]] for r in data], want, rtol=1e-6, atol=1e-9) and rng is not None


@pytest.mark.parametrize("groups", [50_000, 0])
def test_quality_is_the_same_joined_or_broadcast(spark, monkeypatch, groups):
    monkeypatch.setattr(quality, "FEW_GROUPS", groups)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(_fixed())], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: round(r["distance"], 6) for r in quality.quality(docs).collect()}
    assert test_quality_is_the_same_joined_or_broadcast.__dict__.setdefault("seen", got) == got


def _fixed():
    own = random.Random(4)
    return [" ".join(f"w{own.randrange(200)}" for _ in range(own.randrange(60, 200))) for _ in range(120)]


def test_near_duplicate_recall(spark):
    """Every twentieth document against all, by brute force: similar pairs that share a component."""
    base = [[f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 200))] for _ in range(60)]
    texts = []
    for w in base:
        for _ in range(7):
            v = list(w)
            for _ in range(rnd.randrange(0, len(w) // 40 + 1)):
                v[rnd.randrange(len(v))] = f"n{rnd.randrange(10**6)}"
            texts.append(v)
    rows = [(i, " ".join(v)) for i, v in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5).collect()}
    sets = [{tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in texts]
    pairs = [(a, b) for a in range(0, len(texts), 20) for b in range(len(texts)) if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) / len(pairs) >= 0.99


def test_leak_shares_equal_an_exhaustive_scan():
    """The search by itself, with a projection of random numbers: all pairs whose best window matches, and their shares."""
    rng = np.random.default_rng(7)
    items = [rng.integers(1, 2000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (16, 30, 31, 60, 120)]
    docs = [rng.integers(1, 2000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (5, 90, 300, 4000, 0)]
    for k, item in enumerate(items):
        near = item.copy()
        near[:: 9] = np.uint64(k)
        docs.append(np.concatenate([docs[2][: 40 + k], near, docs[3][:77]]))
    projection = rng.normal(size=(decontaminate.FEATURES, 64)).astype(np.float32)

    class Shared:
        value = (list(enumerate(items)), projection)

    index = decontaminate._index("test", Shared)
    together = decontaminate.find_leaks(docs, *index)
    assert together == [decontaminate.find_leaks([d], *index)[0] for d in docs]
    for k in range(len(items)):
        assert together[5 + k].get(k, 0) > 0.8
    assert not any(together[:5])


def test_small_decomposition_has_the_singular_vectors():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 8)) @ np.diag([9, 7, 5, 4, 3, 2, 1.5, 1]) @ rng.normal(size=(8, 50)) + 0.01 * rng.normal(size=(300, 50))
    start = rng.normal(size=(50, 14))
    vectors, values = decontaminate.decomposed(start, a.T @ (a @ start), 8)
    _, s, v = np.linalg.svd(a)
    assert np.allclose(values, s[:8], rtol=1e-3) and np.allclose(np.abs(np.sum(vectors[:, :4] * v[:4].T, axis=0)), 1, atol=1e-3)
