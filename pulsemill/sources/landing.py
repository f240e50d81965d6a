"""Landing messages as files: `<base>/<yyyyMMdd>/<HHmmss>/data.parquet` in UTC, then a marker.

`land` writes one flush. `start_lander` runs it every `interval` over a stream of JSON messages, so buffering, time-outs and
recovery are those of the streaming engine: unlike a hand-written buffer it flushes when messages stop, and loses nothing
on a restart.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..schemas import MESSAGE
from .files import Folders

FLUSH = "30 seconds"


def decoded(messages: DataFrame, schema: StructType = MESSAGE, value: str = "value") -> DataFrame:
    """JSON text or bytes as columns; messages that can't be read have nulls."""
    return messages.select(F.from_json(F.col(value).cast("string"), schema).alias("m")).select("m.*")


def land(rows: DataFrame, base: str, started: dt.datetime | None = None, marker: str = "_READY") -> str | None:
    """Write one flush: data to the side, moved in one step, then the marker. None if there are no rows.

    A second flush of the same second gets a folder of its own by a suffix.
    """
    if rows.isEmpty():
        return None
    started = started or dt.datetime.now(dt.timezone.utc)
    files = Folders(rows.sparkSession)
    side = f"{base}/.landing-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(side)  # one flush is one file, of a few seconds' messages
    part = next(n for n in files.names(side) if n.startswith("part-"))
    folder = plain_folder = f"{base}/{started:%Y%m%d}/{started:%H%M%S}"
    k = 1
    while files.exists(folder):
        folder, k = f"{plain_folder}_{k}", k + 1
    files.move(f"{side}/{part}", f"{folder}/data.parquet")
    files.remove(side)
    files.write_new(f"{folder}/{marker}", "")
    return folder


def by_second(path: str) -> str:
    """A landed path as its flush's second names it, without the suffix that tells flushes of one second apart."""
    return re.sub(r"(/\d{8}/\d{6})_\d+(?=/|$)", r"\1", path)


def start_lander(messages: DataFrame, base: str, checkpoint: str, interval: str = FLUSH, once: bool = False) -> StreamingQuery:
    """Land a stream with a `value` column of JSON messages."""
    writer = decoded(messages).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: land(rows.persist(), base) and rows.unpersist())
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
