"""Helpers shared by the corpus operators: scratch tables and their removal, table reads, Arrow text access.

Every table that `stored` writes has an owner that removes it: the innermost open `workspace`, or, outside of any, the
driver, when it ends. `cleaned` gives an operator a workspace of its own, so only its result stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_root
from ..sources.files import Folders

#: A table of at most so many short rows may be sent to every executor.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_open: list[list[Callable[[], None]]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is removed at the end, also after an error."""
    own: list[Callable[[], None]] = []
    _open.append(own)
    try:
        yield
    finally:
        _open.pop()
        for remove in reversed(own):
            remove()


def owned(spark: SparkSession, path: str, outer: bool = False, remove: Callable[[], None] | None = None) -> None:
    """Give a written table its owner: the workspace (with `outer` the one around it), else the end of the driver."""
    depth = len(_open) - 1 - outer
    if depth >= 0:
        _open[depth].append(remove or (lambda: Folders(spark).remove(path)))
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back; this cuts the lineage."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, name), df.schema
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        owned(spark, path, outer)
    return spark.read.schema(schema).parquet(path)


def cleaned(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator (its first argument is a table) with its result stored and all tables on the way removed."""

    @wraps(operator)
    def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
        with workspace(rows.sparkSession):
            return stored(operator(rows, *args, **kwargs), operator.__name__, outer=True)

    return run


def bounded(df: DataFrame, width: int = 1) -> DataFrame:
    """A stored table with a broadcast hint if it has few rows, by count; `width` tells how many times wider than a short row they are."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_ROWS else df


def by_position(df: DataFrame) -> list:
    """The columns as c0, c1, ..., so that no name of theirs meets one of an operator's own; `named_back` undoes it."""
    return [F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(df.columns)]


def named_back(names: list[str]) -> list:
    return [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]


def with_least(rows: DataFrame, key: str, values: DataFrame, rows_in_all: int) -> DataFrame:
    """`rows` joined on `key` with `values`, which has a row for each key and, as n, how many rows that key has.

    A key of many rows is joined by broadcast, where its rows lie, so it never fills a task; there are at most 50,000 of
    those, as each has over a 50,000th of all rows. The others are joined by shuffle.
    """
    limit = max(256, rows_in_all // 50_000)
    names = [c for c in values.columns if c not in (key, "n")]
    heavy = F.broadcast(values.where(F.col("n") > limit).select(key, F.struct(*names).alias("heavy__")))
    told = rows.join(heavy, key, "left")
    near = told.where("heavy__ IS NOT NULL").select(*rows.columns, "heavy__.*")
    far = told.where("heavy__ IS NULL").drop("heavy__").join(values.where(F.col("n") <= limit).drop("n"), key)
    return near.unionByName(far.select(*rows.columns, *names))


def words_of(text: Column) -> Column:
    """A-Z lower-cased; runs of digits, letters and all that isn't ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def row_keys() -> list[Column]:
    """Two hashes that tell a row's id and text from all others; null-safe."""
    return [F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id").alias("b")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each text of an Arrow string column as UTF-8; null is empty."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = memoryview(column.buffers()[2] or b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i, ok in enumerate(valid):
        yield bytes(data[ends[i] : ends[i + 1]]) if ok else b""


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and the n + 1 offsets; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def byte_blocks(flat: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `most` bytes each, or of one longer row."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b
