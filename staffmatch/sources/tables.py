"""Versioned parquet tables without a merge format.

A new version is written to its own directory, then a row naming it is appended to the version log.
Readers follow the log, so a run that dies half-way leaves the old state in view, and its retry
overwrites only the directory nobody reads. One writer per table is assumed.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("published_at", T.TimestampType()),
])


def read_or_none(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """The parquet table, or None when the path does not exist."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A file scan that splits into fewer tasks than there are cores (one small unsplittable file) is
    shared out by ``key`` before heavy work; larger inputs are left alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/staffmatch-{uuid.uuid4().hex}"


def observed_rows(seen: Observation) -> int:
    """The ``rows`` a write has observed; an empty input may be optimised away with its counter, then none."""
    try:
        return seen.get["rows"]
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return 0


def folder_name(name: str) -> str:
    """A name as one path part; Spark's partition discovery turns it back."""
    return quote(name, safe="")


class TableStore:
    """Named versioned tables under one root folder (any file system Spark can write to)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: object) -> str:
        return "/".join([self.root, *[str(p) for p in parts]])

    def published(self) -> DataFrame:
        """Every version ever published: ``name, version, published_at``."""
        log = read_or_none(self.spark, self.path("_versions"), _LOG)
        return log if log is not None else self.spark.createDataFrame([], _LOG)

    def log(self) -> DataFrame:
        """Newest version per table name."""
        return self.published().groupBy("name").agg(F.max("version").alias("version"))

    def current(self, name: str) -> int:
        """Newest published version, 0 when there is none."""
        row = self.log().where(F.col("name") == name).first()
        return row["version"] if row else 0

    def publish(self, name: str, version: int) -> None:
        row = self.spark.range(1).select(
            F.lit(name).alias("name"), F.lit(version).cast("bigint").alias("version"),
            F.current_timestamp().alias("published_at"),
        )
        row.write.mode("append").parquet(self.path("_versions"))

    def stage(self, name: str, version: int, rows: DataFrame) -> DataFrame:
        """Write a version that is not yet visible; returns it read back from storage."""
        target = self.path(name, f"version={version}")
        rows.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target)

    def read(self, name: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame | None:
        """The published (or the given) version, None when there is none."""
        version = self.current(name) if version is None else version
        if version == 0:
            return None
        return read_or_none(self.spark, self.path(name, f"version={version}"), schema)

    def folders(self, *parts: object) -> list[str]:
        """Names of the folders in a folder; none where it does not exist."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(*parts))
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory()) if files.exists(folder) else []

    def delete_folder(self, *parts: object) -> None:
        """Remove a folder nobody reads any more."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(*parts))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
