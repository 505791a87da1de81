"""Match requirements as they arrive.

Each micro-batch is one ordinary batch match. Every attempt at a batch writes folders of its own, and a row in
``published`` that names batch and attempt is written last. Readers follow these rows, so they see a batch whole or
not at all, and a batch replayed after a failure replaces the earlier attempt in one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import REQUIREMENT_RAW
from ..sources.requirements import parse_requirements
from ..sources.tables import read_or_none

_PUBLISHED = "batch_id bigint, attempt string, published_at timestamp"


def read_reply_stream(spark: SparkSession, path: str, max_files_per_batch: int | None = None) -> DataFrame:
    """Stream of stored replies (``requirement_id, raw``) from JSON-lines files landing in a folder."""
    reader = spark.readStream.schema(REQUIREMENT_RAW)
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.json(path)


def stream_matches(
    replies: DataFrame,
    match_batch: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    processing_time: str = "1 minute",
) -> StreamingQuery:
    """Parse each batch, match the good rows, set the bad ones aside.

    ``match_batch`` maps parsed requirements to matches (it encodes or joins the vectors and calls
    ``match`` or ``search_index``). Writes ``matches`` and ``quarantine`` below ``batch_id=N/attempt=A``, then
    publishes both names; ``read_matches`` and ``read_quarantine`` give what is published. A stream that starts over
    with a new checkpoint deals its batches anew and belongs into a new output folder.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        ok, bad = parse_requirements(batch)
        # A written table, not a cache: the match reads the requirements several times.
        spark, attempt = batch.sparkSession, uuid.uuid4().hex
        folder = f"batch_id={batch_id}/attempt={attempt}"
        parsed = f"{output}/requirements/{folder}"
        ok.write.parquet(parsed)
        match_batch(spark.read.schema(ok.schema).parquet(parsed)).write.parquet(f"{output}/matches/{folder}")
        bad.write.parquet(f"{output}/quarantine/{folder}")
        publish_batch(spark, output, batch_id, attempt)

    writer = replies.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": processing_time}
    return writer.trigger(**trigger).start()


def publish_batch(spark: SparkSession, output: str, batch_id: int, attempt: str) -> None:
    row = spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(attempt).alias("attempt"),
                                F.current_timestamp().alias("published_at"))
    row.write.mode("append").parquet(f"{output}/published")


def published_batches(spark: SparkSession, output: str) -> DataFrame:
    """``batch_id, attempt`` of every batch that is whole, in its newest attempt."""
    rows = read_or_none(spark, f"{output}/published", _PUBLISHED)
    if rows is None:
        rows = spark.createDataFrame([], _PUBLISHED)
    return rows.groupBy("batch_id").agg(F.max_by("attempt", F.struct("published_at", "attempt")).alias("attempt"))


def _published_rows(spark: SparkSession, output: str, kind: str) -> DataFrame | None:
    """The rows of published batches. Their attempts become a filter on folder names, so others are never opened."""
    attempts = [r["attempt"] for r in published_batches(spark, output).collect()]  # a name per batch
    rows = read_or_none(spark, f"{output}/{kind}") if attempts else None
    return rows.where(F.col("attempt").isin(attempts)).drop("attempt") if rows is not None else None


def read_matches(spark: SparkSession, output: str) -> DataFrame | None:
    """Published matches with their ``batch_id``; None before the first."""
    return _published_rows(spark, output, "matches")


def read_quarantine(spark: SparkSession, output: str) -> DataFrame | None:
    """Published replies that could not be parsed; None before the first batch."""
    return _published_rows(spark, output, "quarantine")
