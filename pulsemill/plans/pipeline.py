"""Batch runner: python -m pulsemill.plans.pipeline [env] [mode], with modes all, backfill and latest."""

from __future__ import annotations

import datetime as dt
import sys
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models
from ..session import config_for, session
from ..sources.files import Landed, chunks, raw_files, raw_folders, read_raw
from . import ledger
from .store import Store, Transaction

STAGING, HELPER, DIMENSION, FACT, HOURLY, SPECTRUM = "staging.stg_accelerometer", "curated.location_hlp", "curated.location_dim", "curated.fact_accelerometer", "marts.accel_hourly_summary", "marts.accel_fft_mart"
CDC, BENCHMARK = "staging.processed_files_cdc", "marts.pipeline_benchmark"


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def day_part(column: str):
    return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit("none"))


def merge_by_day(tx: Transaction, table: str, source: DataFrame, time_column: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Upsert a mart, rewriting only the days that the source has. The source is computed once."""
    source = tx.side(source)
    days = sorted(r["d"] for r in source.select(day_part(time_column).alias("d")).distinct().collect())  # days of one batch
    if days:
        tx.replace_parts(table, merge(tx.read(table, days), source), day_part(time_column), days)


def steps(tx: Transaction, read: Callable[[], DataFrame], batch_id: str, config: dict[str, str]) -> list[tuple[str, str, Callable[[dt.datetime], None]]]:
    """(label, target table, what it does) of the six steps of a batch."""

    def stage(now):
        tx.replace(STAGING, models.staged(read(), batch_id, now))

    def helper(now):
        tx.append(HELPER, models.new_locations(tx.read(STAGING), tx.read(HELPER), batch_id, now, config.get("country", "Pakistan")))

    def dimension(now):
        tx.replace(DIMENSION, models.dimension_step(tx.read(DIMENSION), tx.read(HELPER), batch_id, now))

    def fact(now):
        tx.append(FACT, models.facts(tx.read(STAGING), tx.read(DIMENSION), batch_id, now), batch_id)

    def hourly(now):
        source = models.hourly_summary(tx.read(FACT, [batch_id]), tx.read(DIMENSION), batch_id, now)
        merge_by_day(tx, HOURLY, source, "hour_ts", lambda t, s: models.merged_summary(t, s, now))

    def spectrum(now):
        source = models.spectra(tx.read(FACT, [batch_id]), batch_id, now, rate=float(config.get("sample_rate_hz", 100.0)))
        merge_by_day(tx, SPECTRUM, source, "window_ts", lambda t, s: models.merged_spectra(t, s, now, check=False))

    return [("1_staging", STAGING, stage), ("2_location_helper", HELPER, helper), ("3_location_dim", DIMENSION, dimension), ("3_fact", FACT, fact), ("4_hourly_summary", HOURLY, hourly), ("5_spectrum", SPECTRUM, spectrum)]


def batch_rows(tx: Transaction, table: str, batch_id: str) -> int:
    """Rows of the target that carry the batch id; the fact table keeps a batch in a part of its own, so no other is read."""
    return tx.read(table, [batch_id] if table == FACT else None).where(F.col("batch_id") == batch_id).count()


def run_batch(store: Store, read: Callable[[], DataFrame], files: list[Landed], config: dict[str, str], batch_id: str, run_id: str, env: str = "dev") -> None:
    """Run the six steps and record files and metrics. Either all tables have the batch or none has anything of it."""
    size, metrics, error = sum(f.size for f in files), [], None
    try:
        with store.begin() as tx:
            for label, target, act in steps(tx, read, batch_id, config):
                start, clock, before = utc_now(), time.perf_counter(), batch_rows(tx, target, batch_id)
                row = {"run_id": run_id, "env": env, "batch_id": batch_id, "raw_file": ",".join(f.path for f in files), "step_name": label, "sql_file": label, "target_table": target, "data_ingested_bytes": size, "start_ts": ledger.naive(start), "status": ledger.SUCCESS}
                try:
                    act(start)
                    row["data_ingested_rows"] = ledger.row_delta(before, batch_rows(tx, target, batch_id))
                except Exception as e:
                    row |= {"status": ledger.FAILED, "error_message": str(e)[:2000], "data_ingested_rows": 0}
                    raise
                finally:
                    end = utc_now()
                    metrics.append(row | {"duration_ms": 1000 * (time.perf_counter() - clock), "end_ts": ledger.naive(end), "ins_tmstmp": ledger.naive(end)})
            tx.append(CDC, ledger.cdc_rows(store.spark, files, run_id, batch_id, ledger.SUCCESS, utc_now()))
            tx.append(BENCHMARK, ledger.benchmark_rows(store.spark, metrics))
    except Exception as e:
        error = e
    if error is not None:
        with store.begin() as tx:
            tx.append(CDC, ledger.cdc_rows(store.spark, files, run_id, batch_id, ledger.FAILED, utc_now()))
            if metrics:
                tx.append(BENCHMARK, ledger.benchmark_rows(store.spark, metrics))
        raise error


def run_for_files(store: Store, files: list[Landed], config: dict[str, str], batch_id: str, run_id: str, env: str = "dev") -> None:
    if files:
        run_batch(store, lambda: read_raw(store.spark, [f.path for f in files]), files, config, batch_id, run_id, env)


def new_files(store: Store, files: list[Landed]) -> list[Landed]:
    """Those without a SUCCESS row in the ledger, in their order."""
    if not files:
        return []
    listed = store.spark.createDataFrame([(f.path,) for f in files], "raw_file string")
    left = {r["raw_file"] for r in ledger.unprocessed(listed, store.read(CDC)).collect()}
    return [f for f in files if f.path in left]


def new_folders(store: Store, folders: list[str]) -> list[str]:
    if not folders:
        return []
    listed = store.spark.createDataFrame([(f,) for f in folders], "folder string")
    left = {r["folder"] for r in ledger.unprocessed_folders(listed, store.read(CDC)).collect()}
    return [f for f in folders if f in left]


def run(spark: SparkSession, config: dict[str, str], mode: str = "all", env: str = "dev") -> int:
    """Number of batches that ran. Batches run one after another in path order, as merged averages depend on the order."""
    if mode not in ("all", "backfill", "latest"):
        raise ValueError(f"unknown mode {mode}")
    store, run_id = Store(spark, config["catalog_path"]), str(uuid.uuid4())
    files = new_files(store, raw_files(spark, config["data_path"]))
    if mode == "latest":
        files = files[-1:]
    parts = chunks(files, int(config.get("max_files_per_batch", 10)))
    for part in parts:
        run_for_files(store, part, config, uuid.uuid4().hex[:8], run_id, env)
    return len(parts)


def main(args: list[str]) -> int:
    env, mode = (args + ["dev", "all"][len(args) :])[:2]
    if mode not in ("all", "backfill", "latest"):
        print(f"unknown mode {mode}", file=sys.stderr)
        return 1
    config = config_for(env)
    spark = session()
    print(f"{len(new_folders(Store(spark, config['catalog_path']), raw_folders(spark, config['data_path'])))} folders without processed files")
    print(f"{run(spark, config, mode, env)} batches")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
