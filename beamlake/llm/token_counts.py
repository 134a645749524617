"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled.

First tier: the counts of the commonest pre-tokens, broadcast as one string and one byte array of a fixed number of entries, found in
a sample (it decides speed only). Second tier: each worker's cache, which encodes what it has not met. Both are exact."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import map_arrow, removed, table, written
from beamlake.llm.tokens import byte_chunks, byte_counts, tokenizer, tokenizer_path

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Entries of the broadcast table, share of each task's rows that it is made from, and words that a task proposes.
FREQUENT, SAMPLE, PROPOSED = 16_384, 0.02, 4_096
_tables: dict = {}


def frequent_lengths(docs: DataFrame, file: str, entries: int = FREQUENT, fraction: float = SAMPLE) -> tuple[str, bytes]:
    """(words joined by line feeds, a byte for the tokens of each word after a space)."""

    def common(batches):
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if p := byte_chunks(text or ""):
                    n.update(p[1])
        top = n.most_common(PROPOSED)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([k for _, k in top], pa.int64())], names=["word", "n"])

    # only the few words that tasks propose are summed; what is counted in the end stays in its task
    proposed = docs.select("text").sample(fraction, seed=1).mapInArrow(common, "word string, n long")
    chosen = written(proposed.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries), "frequent")
    words = sorted(r["word"] for r in chosen.collect() if "\n" not in r["word"])
    removed(docs.sparkSession, chosen)
    sizes = [len(e.ids) for e in tokenizer(file).encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
    kept = [(w, k) for w, k in zip(words, sizes, strict=True) if k < 256]
    return "\n".join(w for w, _ in kept), bytes(k for _, k in kept)


def frequent_table(mark: str, shared) -> dict[str, int]:
    """The broadcast entries as a dictionary, made once in each worker."""
    if mark not in _tables:
        _tables.clear()
        words, sizes = shared.value
        _tables[mark] = dict(zip(words.split("\n"), sizes, strict=True)) if sizes else {}
    return _tables[mark]


def count_tokens(docs: DataFrame, file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text).

    Null and empty texts have none; special strings count as the library takes them; very long texts are counted whole; repeated rows
    and null doc_ids give a row each; an empty table gives none; other columns are not read."""
    path = file or tokenizer_path(TOKENIZER)
    mark, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def count(batch):
        texts = batch.column(1).to_pylist()
        n = byte_counts(texts, path, frequent_table(mark, shared))
        size = [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts]
        return {"doc_id": batch.column(0), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([k > limit for k in n], pa.bool_())}

    return map_arrow(docs.select("doc_id", "text"), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
