"""Quality rules by robust multivariate outliers: minimum covariance determinant for each language and source.

The concentration steps are aggregates over all rows: distances under the group's centre and precision, the quantile that bounds the
covered share, then moments of the covered rows. A group is one row of moments, so a hot source is pre-aggregated like any other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.base import map_arrow, runs_hashed, table, text_hashes, written

#: Share of a group that the estimate covers, concentration steps, rows below which a group takes the estimate of its language or of all.
COVERED, STEPS, LEAST_ROWS = 0.75, 4, 40
#: Rejected beyond this squared distance: one clean row in several million, were the five variables normal.
CUTOFF = 40.0
#: Transformed statistics with the least change that a text can show (a word, a word of twice the length, a symbol, a line, two runs of three words).
#: Its median over the group is the least standard deviation; constant statistics would otherwise reject any change.
FEATURES = {"log_words": "1 / n_words", "log_word_length": "1 / n_words", "symbols": "sqrt(1 / word_chars)", "dup_lines": "sqrt(1 / n_lines)", "repeats": "sqrt(6 / n_words)"}
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_BASE = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)


def text_statistics(text: str | None, words: np.ndarray | None = None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word; words: their hashes, if known."""
    text = text or ""
    words = text_hashes([text], lower=False)[0] if words is None else words
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeat = 0
    if n > 3:
        h = runs_hashed(words, 3)[0]
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            step = np.zeros(n + 1, np.int64)
            step[:-3] += twice
            step[3:] -= twice
            repeat = int((np.cumsum(step[:-1]) > 0).sum())
    return n, chars, len(text) - len(text.translate(_SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines)


def statistics(docs: DataFrame) -> DataFrame:
    def measure(batch):
        texts = batch.column(3).to_pylist()
        rows = [text_statistics(t, h) for t, h in zip(texts, text_hashes(texts, lower=False), strict=True)]
        n, chars, symbols, dup, repeat, lines = np.array(rows, np.int64).T if rows else np.empty((6, 0), np.int64)
        one = np.maximum(n, 1)
        x = (np.log1p(n), np.log(np.maximum(chars, 1) / one), np.sqrt(symbols / np.maximum(chars, 1)), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(repeat / one))
        return {"doc_id": batch.column(0), "lang": batch.column(1), "source": batch.column(2), "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines, "base_failed": (n < 50) | (100 * repeat > 50 * n)} | dict(zip(FEATURES, x, strict=True))

    return map_arrow(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text"), measure, _BASE)


def _squared_distance():
    k = len(FEATURES)
    away = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    return sum((away[i] * away[j] * F.col("precision")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))


#: Groups whose estimates (some 400 bytes each) are broadcast; more are joined by shuffles.
FEW_GROUPS = 50_000


def sized(groups: DataFrame) -> DataFrame:
    """A written table of groups, marked for broadcast if it is counted and found small."""
    return F.broadcast(groups) if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else groups


def robust_shapes(data: DataFrame, covered: float = COVERED, steps: int = STEPS) -> DataFrame:
    """(lang, source, rows, centre, precision) by deterministic concentration from medians and median deviations.

    Where groups are few, what belongs to them is broadcast, so that rows of a hot group stay where they are."""
    group, names, k = ["lang", "source"], list(FEATURES), len(FEATURES)
    middles = lambda x: F.array(*[F.percentile_approx(e, 0.5, 2000) for e in x])
    centre = written(data.groupBy(group).agg(middles(names).alias("centre"), middles(map(F.expr, FEATURES.values())).alias("floors")), "centres")
    few = sized(centre) is not centre
    small = F.broadcast if few else lambda x: x
    spread = data.join(small(centre), group).groupBy(group).agg(*[F.percentile_approx(F.abs(F.col(f) - F.col("centre")[i]), 0.5, 2000).alias(f) for i, f in enumerate(names)])
    diagonal = F.array(*[F.lit(1.0) / F.pow(F.greatest(F.col(names[i]) * 1.4826, F.col("floors")[i]), 2) if i == j else F.lit(0.0) for i in range(k) for j in range(k)])
    shapes = written(spread.join(small(centre), group).select(*group, "centre", diagonal.alias("precision"), "floors", F.lit(4.351).alias("usual")), "shapes")

    def distance(shapes):
        return data.join(small(shapes), group).withColumn("d2", _squared_distance())

    def invert(batch):
        out = []
        for row in batch.to_pylist():
            n, s, floors = row["n"], np.array(row["s"]), np.array(row["floors"])
            mean = s[:k] / n
            cov = np.empty((k, k))
            cov[np.triu_indices(k)] = s[k:] / n
            cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
            free = max(1.0, np.minimum(1, np.diag(cov) / np.square(floors)).sum())  # variables that vary, those below their floor in part; the median of chi-squared with so many
            scale = np.sqrt(np.maximum(np.diag(cov), np.square(floors)) / np.maximum(np.diag(cov), 1e-18))
            cov = np.where(np.eye(k, dtype=bool), np.maximum(np.diag(cov), np.square(floors)), cov / np.sqrt(np.outer(scale, scale)) * 0.95)
            out.append((mean, np.linalg.pinv(cov, hermitian=True).ravel(), free * (1 - 2 / (9 * free)) ** 3))
        return {"lang": batch.column(0), "source": batch.column(1), "centre": pa.array([m for m, _, _ in out], pa.list_(pa.float64())), "precision": pa.array([p for _, p, _ in out], pa.list_(pa.float64())), "floors": batch.column(4), "usual": pa.array([u for _, _, u in out], pa.float64())}

    moments = F.array(*[F.sum(f) for f in names], *[F.sum(F.col(names[i]) * F.col(names[j])) for i in range(k) for j in range(i, k)])
    for _ in range(steps):
        far = distance(shapes)
        bound = written(far.groupBy(group).agg(F.percentile_approx("d2", covered, 2000).alias("bound")), "bounds")
        inside = far.join(small(bound), group).where("d2 <= bound").groupBy(group).agg(F.count("*").alias("n"), moments.alias("s"), F.first("floors").alias("floors"))
        shapes = written(map_arrow(inside.select(*group, "n", "s", "floors"), invert, "lang string, source string, centre array<double>, precision array<double>, floors array<double>, usual double"), "shapes")
    middle = distance(shapes).groupBy(group).agg(F.percentile_approx("d2", 0.5, 2000).alias("middle"), F.count("*").alias("rows"))
    size = F.greatest(F.lit(1.0), F.col("middle") / F.col("usual"))  # covered rows are the closest, so their spread is too small
    few_rows = F.greatest(F.lit(1.0), (F.col("rows") + 1) * (F.col("rows") - 1) / (F.col("rows") * F.greatest(F.col("rows") - k, F.lit(1))))  # spread of a new row about a mean and covariance of so many
    return written(shapes.join(middle, group).select(*group, "rows", "centre", F.transform("precision", lambda p: p / (size * few_rows)).alias("precision")), "shapes")


def judging_shapes(data: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, centre, precision) of every group: its own estimate if it has `least` rows, else that of its language, else of all rows."""
    own = robust_shapes(data)
    if own.where(F.col("rows") < least).isEmpty():
        return own.drop("rows")
    levels = F.inline(F.array(F.struct(F.col("lang").alias("lang"), F.lit("language").alias("source")), F.struct(F.lit("").alias("lang"), F.lit("all").alias("source"))))
    measures = [c for c in data.columns if c not in ("lang", "source")]
    wider = robust_shapes(data.select(*measures, levels))
    shape = F.struct("centre", "precision")
    of_language = wider.where((F.col("source") == "language") & (F.col("rows") >= least)).select("lang", shape.alias("of_language"))
    of_all = wider.where((F.col("source") == "all") & (F.col("rows") > len(FEATURES))).select(shape.alias("of_all"))
    chosen = own.join(F.broadcast(of_language), "lang", "left").join(F.broadcast(of_all), how="left")
    best = F.when(F.col("rows") >= least, shape).otherwise(F.coalesce("of_language", "of_all"))
    return written(chosen.select("lang", "source", best.alias("best")).where("best is not null").select("lang", "source", "best.*"), "judging")


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for each row of docs.

    docs has doc_id, text, lang and source; null languages and sources count as empty ones. Null and empty texts have
    no words and fail the base rules. Groups of fewer than LEAST_ROWS rows that pass the base rules are judged by the estimate of
    their language, or of all rows if that has as few; only a table with no more such rows than variables is not judged (null distance).
    Repeated rows count each. Texts are taken whole; an empty table gives no rows; other columns are not read."""
    data = written(statistics(docs), "statistics")
    judged, d2 = data.join(sized(judging_shapes(data.where("not base_failed"))), ["lang", "source"], "left"), _squared_distance()
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cutoff)).alias("kept"), d2.alias("distance"))


def op7_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
