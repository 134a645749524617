"""From raw documents to packed training sequences: five stages, each written and read again before the next."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from beamlake.llm.base import map_arrow, scratch, table
from beamlake.llm.decontaminate import leaks
from beamlake.llm.near_dedup import near_duplicates
from beamlake.llm.packing import pack
from beamlake.llm.suffix_dedup import remove_repeated_bytes
from beamlake.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids, or null (a null doc_id is never judged a copy)."""
    chosen = ids.select("doc_id").where("doc_id is not null").distinct()
    return docs.where("doc_id is not null").join(chosen, "doc_id", "left_semi").union(docs.where("doc_id is null")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, whatever their doc_id; null and empty texts have the score of the prior and stay. Repeated rows
    are judged alike; an empty table gives one; further columns are dropped."""
    judged = score_toxicity(docs, table(spark, sf_dir, "labels"), others=COLUMNS[1:])
    return judged.where("predicted = 0").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least doc_id. Shingles of five words, similarity 0.8. Rows without words or without a
    doc_id stay; repeated rows go or stay together; an empty table gives one; further columns are dropped."""
    docs = docs.select(*COLUMNS)
    return _only(docs, near_duplicates(docs, k=5, percent=80).where("kept"))


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 100 bytes or more go from all texts but the first; documents stay, with what is left of their text. Null and
    empty texts and rows without a doc_id stay as they are; repeated rows are cut alike; an empty table gives one."""
    docs = docs.select(*COLUMNS)
    cut = remove_repeated_bytes(docs, whole_characters=True, others=("lang", "source", "n_chars", "text"))

    def text(batch):
        gone, was, raw = (batch.column(c).to_pylist() for c in ("n_removed", "text", "kept"))
        kept = [t if not g else r.decode("utf-8", "surrogatepass") for g, t, r in zip(gone, was, raw, strict=True)]
        sizes = [n if not g else len(t) for g, n, t in zip(gone, batch.column("n_chars").to_pylist(), kept, strict=True)]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(kept, pa.string()), "lang": batch.column("lang"), "source": batch.column("source"), "n_chars": pa.array(sizes, pa.int64())}

    return map_arrow(cut, text, _SCHEMA, rows=256)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a benchmark item is found go, whatever their doc_id; null and empty texts hold none and stay. Repeated rows are judged
    alike; an empty table gives one; further columns are dropped."""
    return leaks(docs, table(spark, sf_dir, "benchmark"), others=COLUMNS[1:]).where("kept").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: a row for each piece of each row. A null or empty text is its end alone, a null doc_id stays null,
    repeated rows are packed each; an empty table gives one; further columns are not read."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near-duplicates", near_duplicate), ("repeated substrings", repeated_substrings), ("decontamination", decontaminated), ("packing", packed)]
#: Trained models, signatures and tokenizers cannot be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
