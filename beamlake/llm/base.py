"""What the corpus operators share: tables, shared scratch space, word hashes, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows and bytes of an Arrow batch between Spark and Python: texts are long, and each task holds a few batches on both sides.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def keep_freed(array: int, size: int) -> None:
    """Freed arrays up to `array` bytes stay with the worker, `size` bytes of them at most; all else goes back to the system. Without a bound
    it would keep what its largest batch once took."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, array)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, size)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library: it has rules of its own
        pass


pa.set_memory_pool(pa.system_memory_pool())
keep_freed(6 << 20, 12 << 20)


def modest(spark: SparkSession) -> None:
    """Small Arrow batches, unless the session asks for still smaller ones."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS or int(spark.conf.get(rows)) <= 0:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as spark.checkpoint.dir names it. Where it is unset one is made, but only for local masters."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='beamlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors. The shuffle files of the job go with it."""
    spark, path, clean = df.sparkSession, scratch(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing reads any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of text that a task works on at once (one longer text is taken whole).
PIECE_TEXT = 4 << 20


def sliced(batch: pa.RecordBatch, column: int | None, rows: int, size: int = PIECE_TEXT):
    """The batch in slices of at most `rows` rows and, unless a single row has more, `size` bytes in the given column of texts."""
    if column is None:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        return
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(end, (end[at - 1] if at else 0) + size, "right"))
        stop = min(at + rows, max(at + 1, full))
        yield batch.slice(at, stop - at)
        at = stop


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = 512, text: str = "text") -> DataFrame:
    """function gets slices of at most `rows` rows (and PIECE_TEXT bytes of the text column, if there is one) and returns columns by name."""
    modest(df.sparkSession)
    place = df.columns.index(text) if text in df.columns else None

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, place, rows):
                out = function(piece)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in out.values()], names=list(out))

    return df.mapInArrow(run, schema)


def carried(df: DataFrame, others: tuple[str, ...]) -> str:
    """The end of a schema: columns that are carried through as they are."""
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in others)


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """Runs without space, tab, line feed, vertical tab, form feed or carriage return, as UTF-8; only A-Z are lowered."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes hashed at once (their arrays fit a core's cache), and powers of an odd number and of its inverse.
HASH_PIECE, _ODD = 1 << 15, 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS[0]):
        return tuple(np.cumprod(np.append(U64(1), np.full(n - 1, x, U64))) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    return _POWERS[0][:n], _POWERS[1]


_POWERS = tuple(np.cumprod(np.append(U64(1), np.full(HASH_PIECE - 1, x, U64))) for x in (_ODD, pow(_ODD, -1, 1 << 64)))


def stretches(raw: bytes, marks: bytes, size: int = HASH_PIECE):
    """(start, end) of stretches of at most `size` bytes that end behind one of the marks, unless there is none so near."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > size:
            end = max(raw.rfind(marks[i : i + 1], at, at + size) for i in range(len(marks))) + 1
            if end <= at:
                found = [x for i in range(len(marks)) if (x := raw.find(marks[i : i + 1], at)) >= 0]
                end = min(found) + 1 if found else len(raw)
        yield at, end
        at = end


def stretch_hashes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unmixed polynomial hashes of the bytes from each start to its end, by running sums: the same wherever they stand."""
    up, down = powers(len(piece))
    total = np.concatenate([[U64(0)], np.cumsum(values[piece] * up)])
    return (total[ends] - total[starts]) * down[starts]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0xE7037ED1A0B428DB))


def text_hashes(texts: list[str | None], lower: bool) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words (as words_of() has them), a batch at a time."""
    raws = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    raw = b"\n".join(raws)
    raw = raw.lower() if lower else raw
    every, places, hashed = np.frombuffer(raw, np.uint8), [np.empty(0, np.int64)], [np.empty(0, U64)]
    for at, end in stretches(raw, b" \n"):
        piece = every[at:end]
        solid = np.concatenate([[False], ~_SPACE[piece], [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edge[::2], edge[1::2]
        places.append(starts + at)
        hashed.append(mixed(stretch_hashes(piece, starts, ends, _WORD_VALUES)))
    places, hashed = np.concatenate(places), np.concatenate(hashed)
    cut = np.searchsorted(places, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    return [hashed[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def doubled(h: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Sums of runs of 1, 2, 4, ... items, up to the longest: a fixed odd-weighted sum of the items' 64-bit hashes."""
    steps, length = {1: h}, 1
    while 2 * length <= longest:
        n = max(0, len(h) - 2 * length + 1)
        steps[2 * length] = steps[length][:n] * U64(0xD6E8FEB86659FD93 + 4 * length) + steps[length][length : length + n]
        length *= 2
    return steps


def run_at(steps: dict[int, np.ndarray], k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the run of k items at each place, or at the given ones: the sums that make it up, mixed at the end."""
    n, total, done = max(0, len(steps[1]) - k + 1), None, 0
    for size in sorted((s for s in steps if s & k), reverse=True):
        part = steps[size][done : done + n] if at is None else steps[size][at + done]
        total = part if total is None else total * U64(0x9E3779B97F4A7C15) + part
        done += size
    return mixed(total)


def runs_hashed(h: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length one hash of every run of so many items, by doubling: O(n log length)."""
    steps = doubled(h, max(lengths))
    return [run_at(steps, k) for k in lengths]


def least_positions(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w items the position of its least one, the rightmost of equals.

    Block minima from both sides (one pass each), so the cost does not depend on w."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    pad = -len(h) % w
    # order by (value, position from the right): the rank makes equal values distinct
    big = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, U64)]).reshape(-1, w)
    left = np.minimum.accumulate(big, axis=1)
    right = np.minimum.accumulate(big[:, ::-1], axis=1)[:, ::-1]
    at = np.arange(big.size).reshape(-1, w)
    # position of the rightmost least value in each prefix and of each suffix of a block
    left_at = np.maximum.accumulate(np.where(big == left, at, -1), axis=1)
    is_new = big == right
    is_new[:, :-1] &= right[:, :-1] < right[:, 1:]
    back = np.where(is_new, at, np.iinfo(np.int64).max)[:, ::-1]
    right_at = np.minimum.accumulate(back, axis=1)[:, ::-1]
    left, right, left_at, right_at = (x.reshape(-1) for x in (left, right, left_at, right_at))
    i = np.arange(n)
    j = i + w - 1
    return np.where(left[j] <= right[i], left_at[j], right_at[i])


#: Edges of spanning forests up to which one task joins them all (at most twice as many ids, some 60 MB there).
ONE_TASK = 1 << 18


def components(edges: DataFrame, name: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for every id in edges(a, b): the least id that can be reached.

    Each task first joins its own edges by union-find and passes on a spanning forest. Up to one_task edges (a size that is counted)
    one further task does the same to all of these; beyond, large-star and small-star rounds of SQL joins run until nothing changes.
    Edges stay on the executors; every table is written to the shared folder."""

    def forest(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p] if p in parent else p
                x = p
            return x

        def out():
            keys = [k for k in parent if root(k) != k]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([root(k) for k in keys], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 1_000_000:
                yield out()
                parent = {}
        yield out()

    spark = edges.sparkSession
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(forest, "a long, b long"), name)
    left = now.count()
    if left <= one_task:
        done = written(now.coalesce(1).mapInArrow(forest, "a long, b long"), name) if left else now
        return done.select(F.col("a").alias("id"), F.col("b").alias("component"))
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour is linked to the least of the neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: of each node and its smaller neighbours all are linked to the least
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor).where("a <> b").distinct()
        after = written(small, name)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        removed(spark, now)
        now = after
        if before is not None and tuple(mark) == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = tuple(mark)


def one_blas_thread() -> None:
    """Keeps numpy's OpenBLAS to the task's own core; several workers with a thread for each core would only wait for each other."""
    global _limited
    if _limited:
        return
    _limited = True
    np.dot(np.ones((2, 2)), np.ones((2, 2)))
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        for path in {x.split()[-1] for x in maps if "openblas" in x}:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
                    break


_limited = False
