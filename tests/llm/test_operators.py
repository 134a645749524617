"""The corpus operators against brute force, on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from beamlake.llm import lm, near_dedup, repeats, substring_dedup, suffix_dedup, toxicity
from beamlake.llm.base import components, least_positions, runs_hashed, scratch
from beamlake.llm.decontaminate import common_length, common_subsequence, leaks
from beamlake.llm.packing import pack, plan
from beamlake.llm.quality import quality, text_statistics
from beamlake.llm.substring_dedup import remove_repeated_words
from beamlake.llm.suffix_dedup import remove_repeated_bytes
from beamlake.llm.token_counts import count_tokens
from beamlake.llm.token_output import expand, read_token_shards, repair, shard_row, shard_slice, write_token_shards
from beamlake.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, anchor long, kept boolean, row long"
rnd = random.Random(3)
WORDS = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(400)]
PASSAGE = " ".join(rnd.choice(WORDS) for _ in range(60))


def _text(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = _text(150)
    near = base.split()
    near[70] = "changed"
    texts = [base, " ".join(near), base, None, "", "   \n\t", "one two three", "one two three", _text(80) + " " + PASSAGE, PASSAGE + "\n" + _text(90), _text(6000), "<|endoftext|> A  b\t<|startoftext|>", "a " * 300, "aé" * 200, "# $ % & | " * 30]
    texts += [_text(rnd.randrange(30, 200)) for _ in range(25)] + [PASSAGE.upper() + _text(30)]
    out = [(i * 3, t, rnd.choice(["en", None]), "s", 1, 5, 6, False, 9) for i, t in enumerate(texts)]
    return out + [out[8], (None, base, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pair_compression_round_trip():
    for ids in (np.array([], np.uint32), np.ones(500, np.uint32), np.array([rnd.choice([1, 2, 3]) for _ in range(9000)], np.uint32)):
        symbols, rules, rounds = repair(ids, 10)
        assert (expand(symbols, rules, rounds, 10) == ids).all()
        names = "part seq before n_docs n_ids base doc_ids doc_lengths symbols rules rounds expansion".split()
        row = dict(zip(names, shard_row(0, 0, 0, [1], [ids.tobytes()], 10), strict=True))
        for _ in range(20):
            a = rnd.randrange(len(ids) + 1)
            b = rnd.randrange(a, len(ids) + 1)
            assert (shard_slice(row, a, b) == ids[a:b]).all()
    assert len(symbols) < len(ids) / 2


def test_token_output(spark, docs, rows, empty):
    path = scratch(spark, "t")
    write_token_shards(docs, path, shard_ids=2000)
    got = sorted(map(tuple, read_token_shards(spark, path).collect()), key=lambda r: r[1])
    t, at, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0, []
    for d, x, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    path = scratch(spark, "t")
    write_token_shards(empty, path)
    assert read_token_shards(spark, path).count() == 0


def test_token_counts(docs, rows, empty):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x, *_ in rows)
    assert Counter(map(tuple, count_tokens(docs).collect())) == want
    assert count_tokens(empty).count() == 0


def test_packing(docs, rows, empty):
    got = pack(docs, capacity=64).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and sum(r["length"] > 64 // 3 for r in rs) <= 2
    assert len({(r["doc_id"], r["piece"]) for r in got}) + len([r for r in got if r["doc_id"] == 24]) // 2 == len(got)
    assert pack(empty).count() == 0
    events = plan({100: 5, 60: 4, 40: 9, 10: 30, 1: 7}, 100)
    assert events[:, 4].min() >= 1 and int((events[:, 2] - events[:, 1]).sum()) == 55


def _sets(rows, k):
    out = {}
    for d, x, *_ in rows:
        w = (x or "").encode().lower().split()
        if d is not None:
            out[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, empty, k):
    sets = _sets(rows, k)
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    for r in near_dedup.near_duplicates(docs, k=k).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_torn_documents(spark):
    """One doc_id with two texts joins what is like either of them; an empty text beside it is linked with nothing."""
    a, b = _text(90), _text(90)
    rows = [(5, a + " end"), (7, a), (7, b), (9, b + " end"), (9, ""), (11, _text(90)), (12, None)]
    got = Counter(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()))
    assert got == Counter({(5, 5, True): 1, (7, 5, False): 2, (9, 5, False): 1, (9, 9, True): 1, (11, 11, True): 1, (12, 12, True): 1})


def test_crowded_family(spark):
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randrange(8)):
            w[rnd.randrange(100)] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    sets = _sets(rows, 4)
    root = list(range(300))
    for a in range(300):
        for b in range(a + 1, 300):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(20):
        x = rng.integers(0, 1 << 60, 1000).astype(np.uint64)
        got.append((near_dedup.super_minhash(x[:900], 160) == near_dedup.super_minhash(x[100:], 160)).mean())
    assert abs(np.mean(got) - 0.8) < 0.03


@pytest.mark.parametrize("one_task", [1 << 18, 0])
def test_components(spark, one_task):
    chain = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long"), one_task=one_task).collect()))
    assert all(got.get(i, 0) == 0 for i in range(61)) and got[101] == got[102] == 100


def _brute(docs, rows, units, window):
    """(doc_id, text): units and which of them go; rows of one doc_id in the order of their texts' tags."""
    tag = {r["text"]: r["tag"] for r in docs.select("text", repeats.text_tag()).collect()}
    seen, out = set(), {}
    for d, x in sorted({(d, x) for d, x, *_ in rows if d is not None}, key=lambda r: (r[0], tag[r[1]])):
        u = units(x or "")
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - window + 1):
            w = u[s : s + window] if isinstance(u, bytes) else tuple(u[s : s + window])
            if w in seen:
                gone[s : s + window] = True
            seen.add(w)
        out[d, x] = u, gone
    return out | {(None, x): (u := units(x or ""), np.zeros(len(u), bool)) for d, x, *_ in rows if d is None}


@pytest.fixture(scope="module")
def torn(spark, rows):
    """Rows of one doc_id and different texts, some of them long; near copies that share all but a few words."""
    texts = [_text(40) + " " + PASSAGE, _text(5) + " " + PASSAGE + " " + PASSAGE + _text(9), PASSAGE + " " + _text(300), _text(25000) + " " + PASSAGE]
    near = _text(200).split()
    near = [" ".join(w if i % 67 != k else f"new{k}" for i, w in enumerate(near)) for k in range(12)]
    out = rows + [(5000 + i // 3, t, None, None, 1, 5, 6, False, 9) for i, t in enumerate(texts + near)] + [(3, _text(400), None, None, 1, 5, 6, False, 9)]
    return out, spark.createDataFrame(out, SCHEMA)


@pytest.mark.parametrize("window", [20, 30])
def test_level_doubling(torn, empty, window):
    rows, docs = torn
    want, seen = _brute(docs, rows, lambda x: x.encode().split(), window), []
    got = remove_repeated_words(docs, window).collect()
    assert Counter(map(tuple, (r[:4] for r in got))) == Counter((d, len(u), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(u, gone, strict=True) if not g)).hexdigest()) for d, x, *_ in rows for u, gone in [want[d, x]])
    assert remove_repeated_words(empty).count() == 0
    substring_dedup.repeated_word_spans(docs, window, seen)
    assert [n for n, _ in seen] == substring_dedup.level_lengths(window)[1:] and all(n for _, n in seen)


@pytest.mark.parametrize("crowd, block", [(4096, 1 << 19), (1, 1 << 19), (1, 300), (4096, 2000)])
def test_interval_expansion(torn, empty, crowd, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowd)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows, docs = torn
    want = _brute(docs, rows, lambda x: x.encode(), 100)

    def digest(u, gone):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        return len(u), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(u, np.uint8)[~gone].tobytes()).hexdigest()

    assert Counter(tuple(r[:5]) for r in remove_repeated_bytes(docs).collect()) == Counter((d, *digest(*want[d, x])) for d, x, *_ in rows)
    if crowd > 1:
        for r in remove_repeated_bytes(docs, whole_characters=True).collect():
            bytes(r["kept"]).decode()
        assert remove_repeated_bytes(empty).count() == 0


def test_classes_settle_batch_by_batch():
    """However the sorted rows are cut into batches, the same classes go on; those alone at their anchor go on only if they have others."""
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, [40, 3, 30, 5], (600, 4)), axis=0).T.astype(np.int64)
    x[3] <<= 9
    x = x[:, np.lexsort((x[3], x[2], x[1], x[0]))]

    def run(size):
        parts = [repeats._batch(anchor=p[0], segment=p[1], doc_id=p[2], place=p[3]) for i in range(0, x.shape[1], size) for p in [x[:, i : i + size]]]
        return sorted((tuple(r.values()) for b in repeats.settle(iter(parts)) for r in b.to_pylist() if r["kind"]), key=repr)

    assert run(1) == run(7) == run(10**6)
    classes = Counter(map(tuple, x[:2].T.tolist()))
    anchors = Counter(a for a, _ in classes)
    assert len(run(7)) == sum(anchors[a] > 1 or n > 1 for (a, _), n in classes.items())


def test_common_prefixes():
    text = np.random.default_rng(2).integers(97, 99, 400).astype(np.uint8)
    text[200:260], text[-1] = text[20:80], 0xFE
    order = suffix_dedup.bounded_suffix_order(text, 20)
    twice = text.tobytes() * 2
    for i, p in enumerate(suffix_dedup.short_prefixes(text, order, 20)):
        if i:
            n = next((k for k in range(20) if twice[order[i] + k] != twice[order[i - 1] + k]), -1)
            assert n == p


def test_runs_and_minima():
    h = np.random.default_rng(3).integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 7, 53):
        assert list(least_positions(h, w)) == [max(i for i in range(s, s + w) if h[i] == h[s : s + w].min()) for s in range(200 - w + 1)]
        assert (runs_hashed(h, w)[0][5:] == runs_hashed(h[5:], w)[0]).all()
    assert repeats.covered(6, (np.array([1]), np.array([2])), 2).tolist() == [False, True, True, True, False, False]


def test_toxicity(spark, docs, empty):
    rows = [(i, _text(60) + (" vile filth" if i % 3 == 0 else "") + _text(5), int(i % 3 == 0)) for i in range(300)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y if i != 7 else None) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(table, labels).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and (r["predicted"] == 1) == (r["score"] >= 0.5)
    held = [(r["predicted"], int(r["doc_id"] % 3 == 0)) for r in got if r["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and not any(r["predicted"] for r in none)
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_lm(spark, docs, rows, empty):
    got = lm.score_documents(docs).collect()
    tokens = lambda x: (x or "").encode().lower().split() + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, x, *_ in rows if not held(d) for w in tokens(x))
    N, V = sum(c.values()), len(c)
    want = Counter((d, held(d), len(t := tokens(x)), sum(c[w] > 0 for w in t), N, round(sum(np.log10((c[w] + 1) / (N + V + 1)) for w in t), 4)) for d, x, *_ in rows)
    assert Counter((*r[:5], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_lm_gradient_and_carried_state():
    rng, g = np.random.default_rng(4), lm.Gru()
    doc = rng.integers(2, 50, 90).astype(np.int32)
    assert np.allclose(g.score([doc, doc[:7]], window=8), g.score([doc, doc[:7]], window=90), atol=1e-3)
    total = sum(np.exp(g.log_probs(np.full((1, lm.HIDDEN), 0.3, np.float32).repeat(lm.VOCABULARY, 0), np.arange(lm.VOCABULARY))))
    assert abs(total - 1) < 1e-3
    before = g.score([doc])[0]
    for _ in range(30):
        g.learn_stream(np.tile(doc, 20))
    assert g.score([doc])[0] > before / 2


def test_quality(spark, docs, rows, empty):
    def slow(x):
        words, x = (x or "").encode().split(), x or ""
        runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [y for y in x.split("\n") if y.encode().split()]
        return len(words), sum(len(w.decode()) for w in words), sum(ch in "#*$%&|<>" for ch in x), len(lines) - len(set(lines)), len(hit)

    for _, x, *_ in rows:
        assert text_statistics(x)[:5] == slow(x)
    got = quality(docs).collect()
    assert len(got) == len(rows) and all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    clean = [(i, _text(rnd.randrange(60, 300)), "en", "s") for i in range(200)] + [(900 + i, " ".join(w + "|$#%&*" for w in _text(120).split()), "en", "s") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[900 + i] for i in range(5))
    assert quality(empty).count() == 0


def test_decontamination(spark, docs, empty):
    item = " ".join(f"bench{i}" for i in range(30))
    near = item.split()
    near[4], near[15] = "other", "words"
    rows = [(1, _text(100) + " " + item + " " + _text(50)), (2, " ".join(near)), (3, _text(200)), (4, None), (5, " ".join(item.split()[::-1]))]
    bench = spark.createDataFrame([(7, item), (8, ""), (9, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert [got[i]["kept"] for i in range(1, 6)] == [False, False, True, True, True] and got[1]["item_ids"] == [7]
    two = spark.createDataFrame([(7, item), (8, ""), (9, None), (10, " ".join(f"other{i}" for i in range(20)))], "item_id long, text string")
    for size in (1, 1 << 20):  # item by item, or all at once
        again = {r["doc_id"]: (r["item_ids"], round(r["best_share"], 6)) for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), two, block_bytes=size).collect()}
        assert again == {i: (got[i]["item_ids"], round(got[i]["best_share"], 6)) for i in got}
    assert leaks(empty, bench).count() == 0 and leaks(docs, bench.limit(0)).where("not kept").count() == 0


def test_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert common_length(a, b) == common_subsequence(a, b).sum() == best[-1, -1]
