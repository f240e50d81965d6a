"""

1. The spectrum model over 19.44 million 100 Hz readings on two threads, with the peak memory of the JVM and its Python workers.
2. One landing window of 3,000 readings through all six models, after the session is warm.

Readings are rows of the test data's `events`, repeated along a 100 Hz clock of six locations.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import threading
import time

import psutil
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.operators import models
from pulsemill.plans import pipeline
from pulsemill.plans.store import Store
from pulsemill.queries import NOW
from pulsemill.schemas import FACT
from pulsemill.session import session

EVENTS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1") + "/events.parquet"


def readings(spark, n: int) -> DataFrame:
    events = spark.read.parquet(EVENTS)
    k = events.count()
    clock = spark.range(n).select("id", (F.col("id") % k).alias("event"), (F.floor(F.col("id") / 6)).alias("tick"), F.concat(F.lit("city_"), F.col("id") % 6).alias("location"))
    values = events.select(F.col("event_id").alias("event"), "value", "user_id")
    at = (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("tick") / 100)).cast("timestamp_ntz")
    return clock.join(values, "event").select(at.alias("timestamp"), "location", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (F.col("id") % 100).cast("double").alias("z"))


class Peak(threading.Thread):
    def __init__(self):
        super().__init__(daemon=True)
        self.most, self.on = 0, True

    def run(self):
        me = psutil.Process()
        while self.on:
            total = 0
            for p in [me, *me.children(recursive=True)]:
                try:
                    total += p.memory_info().rss
                except psutil.Error:
                    pass
            self.most = max(self.most, total)
            time.sleep(0.2)


def main(n: int) -> None:
    spark = session("probe", **{"spark.master": "local[2]", "spark.driver.memory": "1500m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "64"})
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="pulsemill-probe-")
    try:
        facts = models.staged(readings(spark, n), "b", NOW).select("timestamp", F.expr("CAST(split_part(location, '_', 2) AS INT)").alias("location_key"), "x", "y", "z", "magnitude", F.col("batch_ts").cast("timestamp_ntz").alias("ins_tmstmp"), "batch_id")
        facts.write.parquet(f"{root}/facts")
        peak = Peak()
        peak.start()
        start = time.perf_counter()
        models.spectra(spark.read.schema(FACT).parquet(f"{root}/facts"), "b", NOW).write.parquet(f"{root}/spectra")
        spectrum = time.perf_counter() - start
        peak.on = False
        out = {"readings": n, "windows": spark.read.parquet(f"{root}/spectra").count(), "spectrum_seconds": round(spectrum, 1), "peak_gib": round(peak.most / 2**30, 2)}
        config = {"data_path": f"{root}/raw", "catalog_path": f"{root}/lake"}
        for k in range(4):  # the first compile code
            readings(spark, 3000).coalesce(1).write.parquet(f"{root}/raw/20260101/00000{k}")
            start = time.perf_counter()
            pipeline.run(spark, config)
            out["landing_seconds"] = round(time.perf_counter() - start, 1)
        out["facts"] = Store(spark, config["catalog_path"]).read(pipeline.FACT).count()
        print(json.dumps(out))
    finally:
        shutil.rmtree(root, ignore_errors=True)
        spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 19_440_000)
