"""Spark session and configuration files."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings the models rely on: one time zone, strict casts, Arrow for the spectrum, adaptive plans. Lists of readings don't
#: shrink before the shuffle, so their aggregation goes over to sorting, which spills, after a few groups.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8",
}

DEFAULTS = {
    "max_files_per_batch": "10",
    "ready_marker_name": "_READY",
    "worker_settle_seconds": "60",
    "worker_max_files_per_run": "500",
    "worker_max_retry_attempts": "10",
    "worker_retry_delay_seconds": "120",
    "sample_rate_hz": "100.0",
    "country": "Pakistan",
}


def session(app: str = "pulsemill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def load_config(path: str) -> dict[str, str]:
    """`key=value` lines; blank lines and lines that start with # are skipped, the first = divides, all values are text."""
    out = dict(DEFAULTS)
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                key, value = line.split("=", 1)
                out[key.strip()] = value.strip()
    return out


def config_for(env: str, folder: str = "config") -> dict[str, str]:
    return load_config(os.path.join(folder, f"{env}.env"))


_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, read from the session.

    Only a local master may go without that setting; it then gets a temporary folder that ends with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="pulsemill-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so they need no path to it.

    The driver's file server hands out the archive, as for `--py-files`.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pulsemill-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/pulsemill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
