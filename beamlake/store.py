"""A folder of Parquet tables with versions. A write makes a new version beside the old one and is seen only when it is complete, so a job
may read the table that it replaces, and one that dies changes nothing."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.operators.bins import PREFIX
from beamlake.operators.entities import cascaded, duplicates, upserted, violations, without_pattern
from beamlake.operators.numbering import ranked
from beamlake.schema import PARENTS, TABLES, UNIQUE, checks, conforming

_VERSION = re.compile(r"/version=(\d+)/")
VIEW_COLUMNS = ("sensor_position", "sensor_orientation", "direction", "azimuth_angle", "elevation_angle", "spherical_range", "p0", "p1")
ASSOCIATION_COLUMNS = ("polygon_id", "surface_distance", "beam_distance", "zenith", "azimuth", "t")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _latest(self, table: str) -> int | None:
        """The newest complete version: files appear only when their job commits. Lists names, reads nothing."""
        try:
            files = self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}").inputFiles()
        except AnalysisException:
            return None
        return max((int(m[1]) for f in files if (m := _VERSION.search(f))), default=None)

    def init(self, srid: int | None = None, srs_name: str | None = None) -> None:
        """Empty tables where there are none."""
        for table in TABLES:
            if self._latest(table) is None:
                self.write(table, self.spark.createDataFrame([], TABLES[table]))
        if srid is not None:
            self.set_srid(srid, srs_name)

    def read(self, table: str) -> DataFrame:
        n = self._latest(table)
        empty = self.spark.createDataFrame([], TABLES[table])
        return empty if n is None else self.spark.read.schema(empty.schema).parquet(f"{self.root}/{table}/version={n}")

    def write(self, table: str, df: DataFrame, partition_by: str | None = None) -> None:
        n = self._latest(table)
        writer = conforming(df, table).write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/version={(n or 0) + 1}")

    def append(self, table: str, df: DataFrame) -> None:
        """Adds files to the newest version."""
        conforming(df, table).write.mode("append").parquet(f"{self.root}/{table}/version={self._latest(table) or 1}")

    def view(self, *tables: str) -> None:
        """Temporary views by name, for SQL."""
        for table in tables or TABLES:
            self.read(table).createOrReplaceTempView(table)

    def get_or_create(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows by their unique key, new ones with further ids; what is there stays as it is. Returns all of them with ids."""
        keys = list(UNIQUE[table])
        have = self.read(table)
        ids = upserted(have.select("id", *keys), rows, keys)
        new = ids.join(have.select("id"), "id", "left_anti").select("id", *[F.col(k).alias(f"_{k}") for k in keys])
        given = rows.dropDuplicates(keys).drop("id")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        fresh = new.join(given, on).select("id", *given.columns)
        self.append(table, self.checked(table, fresh))
        return self.read(table)

    def checked(self, table: str, rows: DataFrame) -> DataFrame:
        """The rows; an error that names the first failed check, if any."""
        bad = violations(conforming(rows, table), checks(table)).select("violation").first() if checks(table) else None
        if bad:
            raise ValueError(f"{table}: {bad[0]}")
        return rows

    def register(self, table: str, rows: DataFrame, on_duplicate: str = "append") -> DataFrame:
        """Adds rows with further ids and returns them. on_duplicate="error": a key that is there already (null equal to null) is refused."""
        have, keys = self.read(table), list(UNIQUE.get(table, ()))
        if on_duplicate == "error" and keys and duplicates(have.select(*keys).unionByName(conforming(rows, table).select(*keys)), keys, nulls_equal=True).take(1):
            raise ValueError(f"{table}: duplicate of {keys}")
        last = have.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        order = [c for c in (*keys, "path", "recording_id", "trajectory_id", "ts_ns", "sequence_index") if c in rows.columns]
        self.append(table, self.checked(table, ranked(rows.drop("id"), order, "id").withColumn("id", F.col("id") + F.lit(last))))
        return self.read(table).where(F.col("id") > last)

    def lookup(self, table: str, **values) -> DataFrame:
        """Rows with these values; None matches null."""
        out = self.read(table)
        for column, value in values.items():
            out = out.where(F.col(column).eqNullSafe(F.lit(value)))
        return out

    def set_srid(self, srid: int, name: str | None = None) -> None:
        """One spatial reference for all; coordinates are not transformed."""
        self.write("srs", self.spark.createDataFrame([(srid, name)], TABLES["srs"]))

    def truncate(self, *tables: str) -> None:
        for table in tables:
            self.write(table, self.spark.createDataFrame([], TABLES[table]))

    def delete(self, table: str, gone) -> None:
        """Deletes rows (where the condition is true) and, table by table, what hangs on them."""
        self.write(table, self.read(table).where(~F.coalesce(gone, F.lit(False))))
        self._cascade(table)

    def _cascade(self, parent: str) -> None:
        for child, links in PARENTS.items():
            for column, of in links:
                if of == parent:
                    self.write(child, cascaded(self.read(child), self.read(parent), column))
                    self._cascade(child)

    def clean_sensor_views(self) -> None:
        self._forget(VIEW_COLUMNS)

    def clean_associations(self) -> None:
        self.truncate("feature_geometry_data")
        self._forget(ASSOCIATION_COLUMNS)

    def clean_signatures(self) -> None:
        self.truncate("signature", "signature_entry")

    def clean_properties(self, prefix: str = PREFIX) -> None:
        self.write("property", without_pattern(self.read("property"), f"{prefix}%"))

    def clean_all(self) -> None:
        self.truncate("feature_geometry_data", "points", "point_cloud_cell", "point_cloud", "trajectory_pose", "trajectory", "recording", "mission", "sensor", "campaign", "platform")

    def _forget(self, columns: tuple[str, ...]) -> None:
        points = self.read("points")
        self.write("points", points.withColumns({c: F.lit(None).cast(points.schema[c].dataType) for c in columns}))

    def drop_all(self) -> None:
        """Empties every table, those too that no cleaning names."""
        self.truncate(*TABLES)

    def info(self) -> dict[str, int]:
        """What jobs run on."""
        context = self.spark.sparkContext
        return {"default_parallelism": context.defaultParallelism, "shuffle_partitions": int(self.spark.conf.get("spark.sql.shuffle.partitions"))}
