"""Point clouds from files: xyz text (plain or zstd), LAS and Parquet, one recording for each file, named by its stem.

Spark lists folders recursively and leaves out hidden files and folders. All readers give path, name, position, ts_ns, intensity,
point_source_id, sensor_position and place (what orders points within a file)."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.functions.vector import point
from beamlake.schema import POINT

#: Formats by suffix. LAZ and E57 need decoders that are not at hand and are refused.
FORMATS = ("xyz", "xyz.zst", "las", "parquet")
COLUMNS = f"path string, name string, place long, position {POINT}, ts_ns long, intensity float, point_source_id int, sensor_position {POINT}"
_XYZ = "x double, y double, z double, intensity float"
#: Points of an Arrow batch of a decoded file.
_BATCH = 1 << 17


def stem(path: Column) -> Column:
    """File name without folder and suffixes of known formats."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), r"\.(xyz|xyz\.zst|las|parquet)$", "")


def _shaped(df: DataFrame, path: Column) -> DataFrame:
    schema = df.sparkSession.createDataFrame([], COLUMNS).schema
    named = df.withColumn("path", path).withColumn("name", stem(path))
    return named.select(*[(F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _decoded(files: DataFrame, decode) -> DataFrame:
    """One file is one row of `files`; its points leave in batches."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = 0
                for part in decode(content):
                    n = len(part["x"])
                    for at in range(0, n, _BATCH):
                        cut = {k: v[at : at + _BATCH] for k, v in part.items()}
                        m = len(cut["x"])
                        xyz = pa.StructArray.from_arrays([pa.array(cut[c], pa.float64()) for c in "xyz"], names=list("xyz"))
                        pick = lambda k, t: pa.array(cut[k], t) if k in cut else pa.nulls(m, t)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pa.array([path] * m, pa.string()), pa.array(np.arange(place, place + m)), xyz, pick("ts_ns", pa.int64()), pick("intensity", pa.float32()), pick("point_source_id", pa.int32())], names=["path", "place", "position", "ts_ns", "intensity", "point_source_id"])
                        place += m

    return files.mapInArrow(run, f"path string, place long, position {POINT}, ts_ns long, intensity float, point_source_id int")


def _las(content: bytes):
    """Points of a LAS file of formats 0 to 3 and 6 to 8: scaled coordinates, intensity, source id; GPS seconds become nanoseconds."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    at = int.from_bytes(content[96:100], "little")
    kind, size = content[104] & 0x3F, int.from_bytes(content[105:107], "little")
    n = int.from_bytes(content[107:111], "little") or int.from_bytes(content[247:255], "little")
    if content[104] & 0x80 or kind not in (0, 1, 2, 3, 6, 7, 8):
        raise ValueError(f"compressed or unknown point format {content[104]}")
    scale, offset = np.frombuffer(content, "<f8", 3, 131), np.frombuffer(content, "<f8", 3, 155)
    late = kind >= 6
    fields = {"names": ["x", "y", "z", "i", "s"], "formats": ["<i4", "<i4", "<i4", "<u2", "<u2"], "offsets": [0, 4, 8, 12, 20 if late else 18], "itemsize": size}
    if late or kind in (1, 3):
        fields = fields | {"names": [*fields["names"], "t"], "formats": [*fields["formats"], "<f8"], "offsets": [*fields["offsets"], 22 if late else 20]}
    for first in range(0, n, _BATCH):
        p = np.frombuffer(content, np.dtype(fields), min(_BATCH, n - first), at + first * size)
        out = {c: p[c] * scale[k] + offset[k] for k, c in enumerate("xyz")} | {"intensity": p["i"].astype(np.float32), "point_source_id": p["s"].astype(np.int32)}
        if "t" in fields["names"]:
            out["ts_ns"] = np.rint(p["t"] * 1e9).astype(np.int64)
        yield out


def _zst_xyz(content: bytes):
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)) as stream:
        lines = io.TextIOWrapper(stream, "utf-8")
        while rows := [x.split()[:4] for x in lines.readlines(1 << 22) if x.strip() and not x.startswith("#")]:
            table = list(zip(*[(*map(float, r), None) if len(r) == 3 else map(float, r) for r in rows], strict=True))
            yield {c: list(v) for c, v in zip(("x", "y", "z", "intensity"), table, strict=True)}


def read_points(spark: SparkSession, folder: str, file_format: str = "xyz", separator: str = " ") -> DataFrame:
    """Points of all files of the format below the folder (or of one file)."""
    if file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format!r}: {', '.join(FORMATS)}")
    pick = {"recursiveFileLookup": "true", "pathGlobFilter": f"*.{file_format}"}
    if file_format == "parquet":
        df = spark.read.options(**pick).parquet(folder)
        place = F.monotonically_increasing_id() if "place" not in df.columns else F.col("place")
        return _shaped(df.withColumn("place", place).withColumn("_file", F.col("_metadata.file_path")), F.col("_file"))
    if file_format == "xyz":
        df = spark.read.options(**pick).option("sep", separator).option("comment", "#").schema(_XYZ).csv(folder)
        df = df.select("*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") * 0 + F.monotonically_increasing_id()).alias("place"))
        return _shaped(df.where("x is not null and y is not null and z is not null").withColumn("position", point("x", "y", "z")), F.col("_file"))
    files = spark.read.format("binaryFile").options(**pick).load(folder).select("path", "content")
    points = _decoded(files, _las if file_format == "las" else _zst_xyz)
    return _shaped(points.withColumnRenamed("path", "_file"), F.col("_file"))
