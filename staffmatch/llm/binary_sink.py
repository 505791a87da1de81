"""Flat binary files written and read by Spark itself.

Spark's text sink writes the bytes of a value as they are, followed by a separator of the writer's choice. Bytes
whose last one is always the same can therefore be written as (all but the last) + separator: the file then holds
exactly the given bytes, through the file system and the commit protocol of every other Spark sink, so that lost
tasks and repeated attempts leave no torn files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(rows: DataFrame, column: str, separator: str, path: str) -> None:
    """Write the binary `column` of every row, each followed by `separator` (ASCII), one file per partition."""
    if not separator.isascii() or not separator:
        raise ValueError("the separator has to be ASCII text")
    rows.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator).text(path)


def file_contents(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """(path, content) of every written file of at least one byte; a file is one row."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", name).load(path)
            .where("length > 0").select("path", "content"))
