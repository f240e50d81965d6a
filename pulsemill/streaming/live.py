"""The batch models on a stream of landed files.

Files arrive through the streaming file source, at most `files_per_trigger` a micro-batch. The source names them only; they
are read as in a batch run, so their physical types may differ. Each micro-batch is a batch of the store, named by its
number, so one that is replayed after a failure is recognised and not folded in twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import models
from ..plans.pipeline import CDC, FACT, HOURLY, merge_by_day, run_batch, utc_now
from ..plans.store import Store
from ..sources.files import Landed, plain, read_raw


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """path, length and modificationTime of landed files; their content is never read here."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return found.select("path", "length", "modificationTime")


def start(spark: SparkSession, path: str, store: Store, checkpoint: str, config: dict[str, str] | None = None, files_per_trigger: int = 10, once: bool = True, interval: str = "30 seconds") -> StreamingQuery:
    """Run all six models for each micro-batch."""

    def fold(rows: DataFrame, number: int) -> None:
        batch_id = f"stream-{number}"
        if store.read(CDC).where(f"batch_id = '{batch_id}' AND status = 'SUCCESS'").isEmpty():
            files = sorted(Landed(plain(r["path"]), r["length"], int(r["modificationTime"].timestamp() * 1000)) for r in rows.collect())  # files_per_trigger at most
            run_batch(store, lambda: read_raw(spark, [f.path for f in files]), files, config or {}, batch_id, batch_id, "stream")

    writer = landed_stream(spark, path, files_per_trigger).writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def start_hourly(source: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Fold a stream of facts (schema of the fact table) into the hourly mart alone."""

    def fold(rows: DataFrame, number: int) -> None:
        batch_id, now = f"stream-{number}", utc_now()
        if not store.read(FACT, [batch_id]).isEmpty():
            return
        with store.begin() as tx:
            tx.append(FACT, rows, batch_id)
            found = models.hourly_summary(tx.read(FACT, [batch_id]), tx.read("curated.location_dim"), batch_id, now)
            merge_by_day(tx, HOURLY, found, "hour_ts", lambda t, s: models.merged_summary(t, s, now))

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold).trigger(availableNow=True).start()
