"""File ledger, step metrics and the job queue: table in, table out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import megabytes, parent_path, retry_delay
from ..operators.models import at
from ..operators.upsert import upsert
from ..schemas import BENCHMARK, CDC, QUEUE
from ..sources.files import Landed

QUEUED, RUNNING, SUCCESS, FAILED = "QUEUED", "RUNNING", "SUCCESS", "FAILED"


def naive(now: dt.datetime) -> dt.datetime:
    return now.astimezone(dt.timezone.utc).replace(tzinfo=None) if now.tzinfo else now


# ---- which files are done


def unprocessed(files: DataFrame, cdc: DataFrame, path: str = "raw_file") -> DataFrame:
    """Files without a SUCCESS row; a failed file comes again. Paths are compared as they are."""
    done = cdc.where(F.col("status") == SUCCESS).select(F.col("raw_file").alias("done"))
    return files.join(done, F.col(path) == F.col("done"), "left_anti")


def unprocessed_folders(folders: DataFrame, cdc: DataFrame, path: str = "folder") -> DataFrame:
    """Folders that hold no file with a SUCCESS row directly."""
    done = cdc.where(F.col("status") == SUCCESS).select(parent_path(F.col("raw_file")).alias("done")).distinct()
    return folders.join(done, F.col(path) == F.col("done"), "left_anti")


def cdc_rows(spark: SparkSession, files: Iterable[Landed], run_id: str, batch_id: str, status: str, now: dt.datetime) -> DataFrame:
    when = naive(now)
    return spark.createDataFrame([(f.path, f.size, run_id, batch_id, status, when, when) for f in files], CDC)


# ---- step metrics


def benchmark_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in BENCHMARK.fields) for r in rows], BENCHMARK)


def failed_steps(benchmark: DataFrame) -> DataFrame:
    """Failed steps, the newest first, with their input in MB."""
    return benchmark.where(F.col("status") == FAILED).select("*", megabytes(F.col("data_ingested_bytes")).alias("data_ingested_mb")).orderBy(F.desc("ins_tmstmp"))


def row_delta(before: int, after: int) -> int:
    return max(after - before, 0)


# ---- the queue


def queue_rows(spark: SparkSession, files: Iterable[Landed], now: dt.datetime) -> DataFrame:
    when = naive(now)
    rows = [(f.path, f.path.rpartition("/")[0], f.size, f.modified_ms * 1_000_000, QUEUED, 0, when, None, None, when, when) for f in files]
    return spark.createDataFrame(rows, QUEUE)


def enqueued(queue: DataFrame, found: DataFrame, now: dt.datetime) -> DataFrame:
    """New files are queued; a known file is queued anew if its size or time differs, and is left alone otherwise."""
    changed = lambda t, s: (t("file_size_bytes") != s("file_size_bytes")) | (t("file_mtime_ns") != s("file_mtime_ns"))
    taken = ("folder_path", "file_size_bytes", "file_mtime_ns")
    update = {c: (lambda t, s, c=c: s(c)) for c in taken} | {
        "status": lambda t, s: F.lit(QUEUED), "attempts": lambda t, s: F.lit(0), "next_retry_ts": lambda t, s: at(naive(now)),
        "last_error": lambda t, s: F.lit(None).cast("string"), "updated_ts": lambda t, s: at(naive(now)),
    }
    return upsert(queue, found.dropDuplicates(["file_path"]), ["file_path"], update, changed, check=False)


def reclaimed(queue: DataFrame, now: dt.datetime, stale_seconds: float) -> DataFrame:
    """RUNNING rows that nobody has touched for `stale_seconds` are queued again; only failures count as attempts."""
    stale = (F.col("status") == RUNNING) & (F.col("updated_ts") < at(naive(now) - dt.timedelta(seconds=stale_seconds)))
    return queue.withColumns({"status": F.when(stale, QUEUED).otherwise(F.col("status")), "next_retry_ts": F.when(stale, at(naive(now))).otherwise(F.col("next_retry_ts"))})


def due(queue: DataFrame, now: dt.datetime, most: int, attempts: int, folders: list[str] | None = None) -> DataFrame:
    """The `most` oldest queued or failed rows whose time has come and whose attempts aren't used up.

    Rows outside the ready folders are left out before the limit, so they can't keep ready ones waiting.
    """
    rows = queue.where(F.col("status").isin(QUEUED, FAILED) & (F.col("attempts") < attempts) & (F.coalesce("next_retry_ts", at(naive(now))) <= at(naive(now))))
    if folders is not None:
        ready = queue.sparkSession.createDataFrame([(f,) for f in folders], "ready string")
        rows = rows.join(ready, F.col("folder_path") == F.col("ready"), "left_semi")
    return rows.orderBy("updated_ts", "file_path").limit(most)


def _marked(queue: DataFrame, paths: list[str], values: dict) -> DataFrame:
    mine = queue.sparkSession.createDataFrame([(p,) for p in paths], "mine string")
    hit = queue.join(F.broadcast(mine), F.col("file_path") == F.col("mine"), "left")  # the files of one batch
    return hit.select(*[(F.when(F.col("mine").isNotNull(), values[f.name]).otherwise(F.col(f.name)) if f.name in values else F.col(f.name)).cast(f.dataType).alias(f.name) for f in QUEUE.fields])


def running(queue: DataFrame, paths: list[str], run_id: str, now: dt.datetime) -> DataFrame:
    return _marked(queue, paths, {"status": F.lit(RUNNING), "last_run_id": F.lit(run_id), "updated_ts": at(naive(now))})


def succeeded(queue: DataFrame, paths: list[str], run_id: str, now: dt.datetime) -> DataFrame:
    return _marked(queue, paths, {"status": F.lit(SUCCESS), "last_error": F.lit(None).cast("string"), "last_run_id": F.lit(run_id), "updated_ts": at(naive(now))})


def failed(queue: DataFrame, paths: list[str], run_id: str, error: str, delay_seconds: float, now: dt.datetime) -> DataFrame:
    """FAILED with one more attempt, to be tried again after a delay that doubles with each, up to 64 times the first."""
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    wait = F.make_dt_interval(secs=retry_delay(delay_seconds, attempts))
    values = {"status": F.lit(FAILED), "attempts": attempts, "last_error": F.lit(error[:2000]), "last_run_id": F.lit(run_id)}
    return _marked(queue, paths, values | {"next_retry_ts": at(naive(now)) + wait, "updated_ts": at(naive(now))})
