"""What the corpus operators left out once: each test failed before its operator did the whole job."""

import random

import numpy as np

import corpus_pipeline
from beamlake.llm import decontaminate, lm, suffix_dedup
from beamlake.llm.quality import quality

rnd = random.Random(12)


def _text(n, words=400):
    return " ".join(f"word{rnd.randrange(words)}" for _ in range(n))


def _junk():
    """One word in two carries a mark: some 8 % of the characters."""
    return " ".join(w + "#" * (i % 2) for i, w in enumerate(_text(150).split()))


def _kept(spark, rows):
    return {r["doc_id"]: r["kept"] for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


def test_quality_rejects_moderate_junk(spark):
    got = _kept(spark, [(i, _text(rnd.randrange(60, 300)), "en", "s") for i in range(200)] + [(900 + i, _junk(), "en", "s") for i in range(5)])
    assert all(got[i] for i in range(200)) and not any(got[900 + i] for i in range(5))


def test_quality_judges_small_groups(spark):
    clean = [(i, _text(rnd.randrange(60, 300)), "en", f"s{i % 20}") for i in range(200)]
    got = _kept(spark, clean + [(900, _junk(), "en", "s3"), (901, _junk(), "en", "alone"), (902, _junk(), "xx", "alone")])
    assert all(got[i] for i in range(200)) and not any(got[900 + i] for i in range(3))


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    """After the seed the one task reports as many tokens as the training documents have."""
    docs = spark.createDataFrame([(i, _text(6)) for i in range(300)], "doc_id long, text string")
    trained = []
    monkeypatch.setattr(lm, "_averaged", lambda parts: (trained.append(parts.agg({"tokens": "max"}).first()[0]), lm.np.empty(0, lm.np.float32))[1])
    rows = lm.score_documents(docs.coalesce(1), seed_docs=10).collect()
    assert trained[1] == sum(r["n_tokens"] for r in rows if not r["held_out"]) == rows[0]["train_tokens"]


def _zipf(n):
    return [f"word{int(3000 ** rnd.random())}" for _ in range(n)]


def test_decontamination_finds_all_that_brute_force_finds(spark):
    """Items with their rarest fifth replaced, in texts of the same words; every item against every window of every text."""
    items = [_zipf(40) for _ in range(30)]
    docs = [_zipf(rnd.randrange(60, 200)) for _ in range(120)]
    for i, doc in enumerate(docs[:90]):
        near, at = list(items[i % 30]), rnd.randrange(len(doc))
        for j in sorted(range(40), key=lambda j: -int(near[j][4:]))[: 4 * (i % 3)]:
            near[j] = f"other{rnd.randrange(9**9)}"
        doc[at:at] = near
    hashed = [decontaminate.tokens(" ".join(x)) for x in items]

    def slow(doc):
        h = decontaminate.tokens(" ".join(doc))
        return {k for k, item in enumerate(hashed) if any(decontaminate.matches(item, h[i : i + 50]) for i in range(0, len(h), 5))}

    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.leaks(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string"), bench).collect()}
    want = {i: slow(doc) for i, doc in enumerate(docs)}
    assert sum(map(len, want.values())) >= 90 and all(want[i] <= got[i] for i in want)


def test_passage_counts_cover_every_document_and_tail(spark):
    docs = [_zipf(90) + [f"tail{i % 50}"] for i in range(4500)]
    idf, _ = decontaminate.fit(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string"))
    count, n = np.zeros(decontaminate.FEATURES), 0
    for doc in docs:
        f = decontaminate.features(decontaminate.tokens(" ".join(doc)))
        for p in (f[:64], f[64:]):
            count[np.unique(p)] += 1
            n += 1
    assert np.allclose(idf, np.maximum(np.log((n + 10) / (count + 5)), 0) + 0.1, atol=1e-5)


def test_pipeline_judges_rows_without_or_with_repeated_ids(spark, tmp_path):
    """Toxic and contaminated rows go when their id is null or another row's; clean ones with the same id stay, nulls and all."""
    item = " ".join(f"q{i}" for i in range(25))
    rows = [(i, _text(60) + " filthword" * (i % 2)) for i in range(120)]
    spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, bad):
        extra = [(None, "clean0 " + _text(60)), (None, "bad0 " + _text(30) + bad), (500, "clean1 " + _text(60)), (500, "bad1 " + _text(30) + bad), (None, None)]
        docs = spark.createDataFrame([(i, t, None, "s", 7) for i, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
        out = stage(spark, docs, str(tmp_path))
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        kept = out.collect()
        assert all((r["lang"], r["source"], r["n_chars"]) == (None, "s", 7) for r in kept)
        return sorted((r["text"] or "none").split()[0] for r in kept if r["doc_id"] in (None, 500))

    assert left(corpus_pipeline.toxicity, " filthword") == left(corpus_pipeline.decontaminated, f" {item}") == ["clean0", "clean1", "none"]


def _dealt(spark, monkeypatch, common):
    """key -> distinct texts that meet by it, of 300 documents that have nothing in common but one passage."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    docs = [(i, "".join(rnd.choices(letters, k=150)) + common + "".join(rnd.choices(letters, k=150))) for i in range(300)]
    out, real = {}, suffix_dedup.map_arrow

    def kept(*args, **options):
        cuts = real(*args, **options)
        for r in cuts.collect():
            out.setdefault(r["key"], set()).add(bytes(r["payload"]))
        return cuts

    monkeypatch.setattr(suffix_dedup, "CROWDED", 20)
    monkeypatch.setattr(suffix_dedup, "map_arrow", kept)
    assert suffix_dedup.repeated_byte_spans(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0
    return out


def test_texts_that_share_less_than_a_window_are_not_expanded(spark, monkeypatch):
    assert not _dealt(spark, monkeypatch, "Forty bytes that all documents have here")


def test_no_key_of_the_expansion_grows_with_its_crowd(spark, monkeypatch):
    """Seventy bytes are common, windows of a hundred are not: what is carried from block to block stays small."""
    dealt = _dealt(spark, monkeypatch, "Seventy bytes that all of these documents have in common, no more, no.")
    assert dealt and max(map(len, dealt.values())) <= 20
