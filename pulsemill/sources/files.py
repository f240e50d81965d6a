"""Discovery of landed files, and reading files whose physical types differ.

Listing goes through the Hadoop file system of the path, so any store that Spark reads will do.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW

FOOTERS_AT_ONCE = 16


class Landed(NamedTuple):
    path: str
    size: int
    modified_ms: int


class Folders:
    """A thin view of the Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def walk(self, path: str) -> tuple[list[str], list[Landed]]:
        """All folders, the root included, and all files below `path`; hidden names are left out."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return [], []
        folders, files, todo = [plain(path)], [], [p]
        while todo:
            for s in fs.listStatus(todo.pop()):
                name = s.getPath().getName()
                if name.startswith("."):
                    continue
                if s.isDirectory():
                    folders.append(plain(s.getPath().toString()))
                    todo.append(s.getPath())
                else:
                    files.append(Landed(plain(s.getPath().toString()), s.getLen(), s.getModificationTime()))
        return sorted(folders), sorted(files)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Write a whole file at once under a name that isn't taken; False if it is."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        side = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{time.time_ns()}")
        out = fs.create(side, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(side, p):
            fs.delete(side, False)
            return False
        return True

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(to.getParent())
        if not fs.rename(p, to):
            raise OSError(f"can't move {source} to {target}")

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def plain(path: str) -> str:
    """A path as it is recorded: `file:` off, no slash at the end."""
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return path.rstrip("/") or "/"


def parent(path: str) -> str:
    return plain(path).rpartition("/")[0]


def raw_files(spark: SparkSession, data_path: str) -> list[Landed]:
    """All parquet files below the folder, by path."""
    return [f for f in Folders(spark).walk(data_path)[1] if f.path.endswith(".parquet")]


def raw_folders(spark: SparkSession, data_path: str) -> list[str]:
    return Folders(spark).walk(data_path)[0]


def ready_folders(spark: SparkSession, data_path: str, marker: str = "_READY", settle_seconds: float = 60, now: float | None = None) -> list[str]:
    """Folders whose marker is at least `settle_seconds` old."""
    now = time.time() if now is None else now
    files = Folders(spark).walk(data_path)[1]
    return sorted({parent(f.path) for f in files if f.path.rpartition("/")[2] == marker and now - f.modified_ms / 1000 >= settle_seconds})


def files_in(spark: SparkSession, folders: list[str]) -> list[Landed]:
    """Parquet files under the folders, each once, by path."""
    return sorted({f for folder in folders for f in raw_files(spark, folder)})


def chunks(items: list, size: int) -> list[list]:
    """Consecutive parts of `size`; all in one part if that is 0 or less."""
    return [items] if size <= 0 and items else [items[k : k + size] for k in range(0, len(items), max(size, 1))]


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Readings from files whose columns may differ in physical type: files of one schema are read together and cast.

    Values are cast to the canonical types before anything is computed, so no value depends on which file comes first.
    Extra columns are left out, a missing one is an error. Footers are read by jobs of one task each, several at once.
    """
    if not paths:
        return spark.createDataFrame([], RAW)
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        schemas = list(pool.map(lambda path: spark.read.parquet(path).schema, paths))  # each reads one footer
    for path, fields in zip(paths, schemas):
        lost = {f.name for f in RAW.fields} - set(fields.names)
        if lost:
            raise ValueError(f"{path} has no column {', '.join(sorted(lost))}")
        groups.setdefault(str([(f.name, fields[f.name].dataType.simpleString()) for f in RAW.fields]), []).append(path)
    parts = [spark.read.parquet(*group).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields]) for group in groups.values()]
    return reduce(DataFrame.unionByName, parts)
