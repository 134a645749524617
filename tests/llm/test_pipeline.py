"""Each stage keeps what it should of what its predecessor kept."""

import random
import shutil

import pandas as pd

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    item, shared = " ".join(f"q{i}" for i in range(25)), text(70)
    rows = [(i, text(80)) for i in range(200)]
    rows[50] = (50, rows[10][1])
    rows[60] = (60, rows[10][1] + " more")
    rows[70], rows[71] = (70, text(40) + " " + shared + " " + text(50)), (71, text(50) + " " + shared + " " + text(40))
    rows[80] = (80, text(50) + " " + item + " " + text(50))
    rows = [(i, t + " filthword" if i >= 150 and i % 2 else t) for i, t in rows] + [(500, None), (501, "")]
    pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": "en", "source": "s", "n_chars": [len(r[1] or "") for r in rows]}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": range(200), "quality": 1, "toxic": [int(i >= 150 and i % 2) for i in range(200)]}).astype({"quality": "int32", "toxic": "int32"}).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(tmp_path / "benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.toPandas())
    toxic, near, cut, clean, packed = seen
    assert all(list(x.columns) == list(corpus_pipeline.COLUMNS) for x in seen[:4])
    assert set(toxic.doc_id) == {r[0] for r in rows} - {i for i in range(150, 200) if i % 2}
    assert set(toxic.doc_id) - set(near.doc_id) == {50, 60}
    assert set(cut.doc_id) == set(near.doc_id)
    texts = dict(zip(cut.doc_id, cut.text, strict=True))
    assert shared in texts[70] and shared[:100] not in texts[71] and texts[3] == rows[3][1] and texts[500] is None
    assert set(cut.doc_id) - set(clean.doc_id) == {80}
    assert set(packed.doc_id) == set(clean.doc_id) and packed.length.max() <= 2048
    shutil.rmtree(tmp_path)


def _stages(spark, docs, path):
    """Each stage on the rows given, not on what another left."""
    return {name: stage(spark, docs, str(path)).collect() for name, stage in corpus_pipeline.STAGES}


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, ties, long texts, columns with the operators' own names; an empty table."""
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    pd.DataFrame({"doc_id": [1, 2, None], "quality": [1, 0, 1], "toxic": [0, None, 1]}).astype({"doc_id": "Int64", "toxic": "Int32", "quality": "int32"}).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame({"item_id": [1, None], "text": ["q1 q2 q3 q4 q5 q6 q7 q8 q9", None]}).astype({"item_id": "Int64"}).to_parquet(tmp_path / "benchmark.parquet")
    long, same = text(30000), text(60)
    rows = [(1, same, "en", "s", 3), (1, same, "en", "s", 3), (1, text(50), None, None, None), (None, same, "en", None, 2), (None, None, None, None, None), (4, "", "", "", 0), (5, long, "en", "s", 9), (6, "one", "en", "s", 3), (6, "one", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as kept", "'x' as id", "2 as predicted", "3 as tag", "4 as text_", "5 as part", "6 as `key`")
    got = _stages(spark, docs, tmp_path)
    assert [len(got[n]) for n, _ in corpus_pipeline.STAGES[:4]] == [9, 9, 9, 9] and len(got["packing"]) >= 9
    assert sorted(len(r["text"] or "") for r in got["repeated substrings"])[-1] == len(long)
    assert not any(_stages(spark, docs.limit(0), tmp_path).values())
