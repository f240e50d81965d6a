"""The six models, from DataFrame to DataFrame. `now` is one literal for a step; `batch_id` names the batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import first_part, magnitude, rounded, spectrum_frequencies, spectrum_magnitude, truncated
from .upsert import expire, upsert

#: A dimension up to so many rows may be sent to every executor.
BROADCAST_ROWS = 200_000


def at(now: dt.datetime) -> Column:
    return F.lit(now.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast if small, by count; a larger one is joined by shuffle, with adaptive skew splitting."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def staged(raw: DataFrame, batch_id: str, now: dt.datetime) -> DataFrame:
    """Typed readings with their magnitude. Extra columns are left out; a missing one is an error."""
    typed = raw.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("location").cast("string").alias("location"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return typed.select("*", magnitude(F.col("x"), F.col("y"), F.col("z")).alias("magnitude"), F.lit(now.replace(tzinfo=dt.timezone.utc)).alias("batch_ts"), F.lit(batch_id).alias("batch_id"))


def new_locations(staging: DataFrame, helper: DataFrame, batch_id: str, now: dt.datetime, country: str = "Pakistan") -> DataFrame:
    """Helper rows for the locations that no helper row has, case folded; keys follow on in order of the name, null last.

    A null location is never found, so each batch gives it a new key; spellings that differ in case within one batch
    each get a key. The order needs one task, over the distinct new names alone.
    """
    names = staging.select("location").distinct()
    fresh = names.join(helper.select(F.lower("location_name").alias("known")), F.lower("location") == F.col("known"), "left_anti")
    top = helper.agg(F.coalesce(F.max("location_key"), F.lit(0)).alias("top"))
    numbered = fresh.select("location", F.row_number().over(Window.orderBy(F.asc_nulls_last("location"))).alias("n")).crossJoin(F.broadcast(top))  # one row
    return numbered.select(
        (F.col("top") + F.col("n")).cast("int").alias("location_key"), F.col("location").alias("location_name"), first_part(F.col("location")).alias("city"),
        F.lit(country).alias("country"), at(now).alias("ins_tmstmp"), at(now).alias("upd_tmstmp"), F.lit(batch_id).alias("batch_id"),
    )


def expired_dimension(dimension: DataFrame, helper: DataFrame, now: dt.datetime) -> DataFrame:
    """Current rows whose city or country changed in the helper are closed; null never counts as a change."""
    changed = lambda t, s: (t("city") != s("city")) | (t("country") != s("country"))
    stamp = lambda t, s: at(now)
    update = {"is_current": lambda t, s: F.lit(False), "valid_to": stamp, "upd_tmstmp": stamp, "oper": lambda t, s: F.lit("U")}
    return expire(dimension, helper, ["location_key"], changed, update, F.col("is_current"))


def new_dimension_rows(dimension: DataFrame, helper: DataFrame, batch_id: str, now: dt.datetime) -> DataFrame:
    """Rows for helper rows without a current dimension row; the key stays the same over versions."""
    current = dimension.where("is_current").select(F.col("location_key").alias("k"))
    missing = helper.join(current, F.col("location_key") == F.col("k"), "left_anti")
    return missing.select(
        "location_key", "location_name", "city", "country", F.lit(True).alias("is_current"), at(now).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        at(now).alias("ins_tmstmp"), at(now).alias("upd_tmstmp"), F.lit("I").alias("oper"), F.lit(batch_id).alias("batch_id"),
    )


def dimension_step(dimension: DataFrame, helper: DataFrame, batch_id: str, now: dt.datetime) -> DataFrame:
    closed = expired_dimension(dimension, helper, now)
    return closed.unionByName(new_dimension_rows(closed, helper, batch_id, now))


def facts(staging: DataFrame, dimension: DataFrame, batch_id: str, now: dt.datetime) -> DataFrame:
    """Readings with the key of their current location, null where there is none."""
    known = bounded(dimension.where("is_current").select(F.lower("location_name").alias("known"), "location_key"))
    keyed = staging.join(known, F.lower("location") == F.col("known"), "left")
    return keyed.select("timestamp", "location_key", "x", "y", "z", "magnitude", at(now).alias("ins_tmstmp"), F.lit(batch_id).alias("batch_id"))


def hourly_summary(fact: DataFrame, dimension: DataFrame, batch_id: str, now: dt.datetime) -> DataFrame:
    """Statistics by hour and location of one batch's facts.

    The readings are summed by hour and key first, so the join with the dimension is over the sums.
    """
    m = F.col("magnitude")
    sums = fact.groupBy(truncated("hour", F.col("timestamp")).alias("hour_ts"), "location_key").agg(
        F.count("*").alias("sample_count"), *[rounded(F.avg(c)).alias(f"avg_{c}") for c in ("x", "y", "z", "magnitude")],
        rounded(F.max(m)).alias("max_magnitude"), rounded(F.min(m)).alias("min_magnitude"), rounded(F.stddev_samp(m)).alias("stddev_magnitude"),
    )
    names = bounded(dimension.where("is_current").select(F.col("location_key").alias("k"), "location_name", "city", "country"))
    return sums.join(names, F.col("location_key") == F.col("k"), "left").select(
        "hour_ts", "location_key", "location_name", "city", "country", "sample_count", "avg_x", "avg_y", "avg_z", "avg_magnitude", "max_magnitude", "min_magnitude",
        "stddev_magnitude", at(now).alias("ins_tmstmp"), at(now).alias("upd_tmstmp"), F.lit(batch_id).alias("batch_id"),
    )


def merged_summary(target: DataFrame, source: DataFrame, now: dt.datetime, check: bool = True) -> DataFrame:
    """Fold a batch in: counts add up, averages are the plain mean of the two, the newest deviation stays."""
    mean = lambda c: lambda t, s: rounded((t(c) + s(c)) / 2)
    update = {c: mean(c) for c in ("avg_x", "avg_y", "avg_z", "avg_magnitude")} | {
        "sample_count": lambda t, s: t("sample_count") + s("sample_count"),
        "max_magnitude": lambda t, s: F.greatest(t("max_magnitude"), s("max_magnitude")),
        "min_magnitude": lambda t, s: F.least(t("min_magnitude"), s("min_magnitude")),
        "stddev_magnitude": lambda t, s: s("stddev_magnitude"),
        "upd_tmstmp": lambda t, s: at(now),
        "batch_id": lambda t, s: s("batch_id"),
    }
    return upsert(target, source, ["hour_ts", "location_key"], update, check=check)


def spectra(fact: DataFrame, batch_id: str, now: dt.datetime, unit: str = "minute", rate: float = 100.0) -> DataFrame:
    """Spectrum of each axis and of the magnitude by window and location of one batch's facts.

    One list of readings is gathered a group and sorted by time, then by value, so all axes have one order. A null reading
    is an error.
    """
    reading = F.struct("timestamp", "x", "y", "z", "magnitude")
    groups = fact.groupBy(truncated(unit, F.col("timestamp")).alias("window_ts"), "location_key").agg(F.sort_array(F.collect_list(reading)).alias("r"))
    sound = lambda c: F.when(F.exists(F.col(f"r.{c}"), lambda v: v.isNull()), F.raise_error(F.concat(F.lit(f"null {c} in window "), F.coalesce(F.col("window_ts").cast("string"), F.lit("null"))))).otherwise(F.col(f"r.{c}"))
    n = F.size("r")
    return groups.select(
        "window_ts", "location_key", n.cast("int").alias("sample_count"), spectrum_frequencies(n, rate).alias("freq_hz"),
        *[spectrum_magnitude(sound(c)).alias(f"fft_{c}") for c in ("x", "y", "z", "magnitude")],
        at(now).alias("ins_tmstmp"), at(now).alias("upd_tmstmp"), F.lit(batch_id).alias("batch_id"),
    )


def merged_spectra(target: DataFrame, source: DataFrame, now: dt.datetime, check: bool = True) -> DataFrame:
    """The newest batch's spectrum of a window replaces the former; its first insertion time stays."""
    replaced = ("sample_count", "freq_hz", "fft_x", "fft_y", "fft_z", "fft_magnitude", "batch_id")
    update = {c: (lambda t, s, c=c: s(c)) for c in replaced} | {"upd_tmstmp": lambda t, s: at(now)}
    return upsert(target, source, ["window_ts", "location_key"], update, check=check)
