"""Queue worker: python -m pulsemill.plans.worker [env] [--lock-file FILE]. One run at a time; meant for a scheduler."""

from __future__ import annotations

import argparse
import fcntl
import sys
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ..session import config_for, session
from ..sources.files import chunks, files_in, ready_folders
from . import ledger
from .pipeline import new_files, run_for_files, utc_now
from .store import Store

QUEUE = "staging.realtime_job_queue"
STALE_SECONDS = 6 * 3600


def work(spark: SparkSession, config: dict[str, str], env: str = "dev", now: float | None = None) -> int:
    """Find ready files, queue them, run what is due. 0 if all went well, 1 if a batch failed; others still run."""
    store, run_id = Store(spark, config["catalog_path"]), str(uuid.uuid4())
    get = lambda key, default: int(float(config.get(key, default)))
    folders = ready_folders(spark, config["data_path"], config.get("ready_marker_name", "_READY"), float(config.get("worker_settle_seconds", 60)), time.time() if now is None else now)
    fresh = new_files(store, files_in(spark, folders))
    with store.begin() as tx:
        queue = ledger.reclaimed(tx.read(QUEUE), utc_now(), float(config.get("worker_stale_seconds", STALE_SECONDS)))
        tx.replace(QUEUE, ledger.enqueued(queue, ledger.queue_rows(spark, fresh, utc_now()), utc_now()))
    wanted = ledger.due(store.read(QUEUE), utc_now(), get("worker_max_files_per_run", 500), get("worker_max_retry_attempts", 10), folders)
    paths = [r["file_path"] for r in wanted.collect()]  # at most worker_max_files_per_run
    known = {f.path: f for f in files_in(spark, folders)}
    broken = False
    for part in chunks([known[p] for p in paths if p in known], get("max_files_per_batch", 10)):
        names = [f.path for f in part]
        with store.begin() as tx:
            tx.replace(QUEUE, ledger.running(tx.read(QUEUE), names, run_id, utc_now()))
        try:
            run_for_files(store, part, config, uuid.uuid4().hex[:8], run_id, env)
        except Exception as e:
            broken = True
            with store.begin() as tx:
                tx.replace(QUEUE, ledger.failed(tx.read(QUEUE), names, run_id, str(e), float(config.get("worker_retry_delay_seconds", 120)), utc_now()))
        else:
            with store.begin() as tx:
                tx.replace(QUEUE, ledger.succeeded(tx.read(QUEUE), names, run_id, utc_now()))
    return int(broken)


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("env", nargs="?", default="dev")
    parser.add_argument("--lock-file", default=str(Path(tempfile.gettempdir()) / "pulsemill-worker.lock"))
    given = parser.parse_args(args)
    with open(given.lock_file, "w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            print("another worker is running")
            return 0
        return work(session(), config_for(given.env), given.env)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
