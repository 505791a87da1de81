"""Keep embeddings in step as employee snapshots land.

The stream runs over a manifest folder (one small JSON file per snapshot), not over the snapshot files:
those could be split over several batches, and half a snapshot looks like people leaving.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.embeddings import sync_embeddings
from ..schemas import EMPLOYEE_SKILL, MANIFEST
from ..sources.tables import TableStore


def read_manifest_stream(spark: SparkSession, path: str) -> DataFrame:
    """One manifest (``version, path``) per micro-batch."""
    return spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).json(path)


def applied_name(model: str) -> str:
    return f"snapshots/{model}"


def stream_sync(
    manifests: DataFrame,
    store: TableStore,
    encoder,
    checkpoint: str,
    *,
    detect_changes: bool = False,
    available_now: bool = True,
    processing_time: str = "1 minute",
) -> StreamingQuery:
    """Run the sync job for every manifest in version order.

    Snapshot versions up to the last applied one are skipped, so a replayed batch does nothing.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = store.current(applied_name(encoder.model))
        todo = batch.where(F.col("version") > done).orderBy("version").collect()  # one row per snapshot
        for manifest in todo:
            employees = spark.read.schema(EMPLOYEE_SKILL).parquet(manifest["path"])
            sync_embeddings(store, employees, encoder, detect_changes=detect_changes)
            store.publish(applied_name(encoder.model), manifest["version"])

    writer = manifests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": processing_time}
    return writer.trigger(**trigger).start()
