"""Intermediate tables in the folder that the cluster shares, and the small session helpers around them.

Every multi-step operator cuts its lineage with a written table: a lost executor then costs a re-read, and no
step depends on blocks that only one machine holds.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; where that is unset (tests), one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm"


class Scratch:
    """Tables of one operator run below `<shared folder>/<operator>-<random>`.

    The results of an operator are lazy and may read these tables, so they stay until the caller removes
    `folder` once the result is written.
    """

    def __init__(self, spark: SparkSession, operator: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back with its own schema.

        Shuffle files of the finished job are dropped when its plan objects are collected, so both heaps are
        asked to collect now instead of letting the files of every step pile up.
        """
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
