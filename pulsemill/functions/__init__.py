"""Column functions of the models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def rounded(value: Column, places: int = 4) -> Column:
    """Round in binary: scale, round half away from zero, scale back. Decimal rounding differs at ties such as 5.015."""
    scale = float(10**places)
    return F.round(value * scale, 0) / scale


def truncated(unit: str, at: Column) -> Column:
    """Start of the hour or minute, without a zone; a null time stays a group of its own."""
    return F.date_trunc(unit, at).cast("timestamp_ntz")


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def first_part(name: Column, mark: str = "_") -> Column:
    return F.split_part(name, F.lit(mark), F.lit(1))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def megabytes(size: Column) -> Column:
    return rounded(size / 1024.0 / 1024.0, 2)


def retry_delay(delay: Column | float, attempts: Column) -> Column:
    """delay * 2^min(attempts - 1, 6) seconds."""
    delay = F.lit(delay) if isinstance(delay, (int, float)) else delay
    return delay * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(6)))


@F.pandas_udf(ArrayType(DoubleType()))
def spectrum_magnitude(values: pd.Series) -> pd.Series:
    """Magnitudes of the one-sided spectrum of each series: n // 2 + 1 bins. Null values are an error."""
    return values.map(lambda v: np.abs(np.fft.rfft(np.asarray(v, dtype=np.float64))))


def spectrum_frequencies(n: Column, rate: float) -> Column:
    """Frequencies of the bins of a series of n samples."""
    return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), lambda k: k * F.lit(float(rate)) / n)
