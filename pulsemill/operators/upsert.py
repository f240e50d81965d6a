"""Upsert: a full outer join on equality keys, with update rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


class DuplicateKeys(ValueError):
    """Two source rows for one target row."""


def check_source(target: DataFrame, source: DataFrame, keys: list[str]) -> None:
    """Raise if two source rows match one target row."""
    twice = source.groupBy(*keys).count().where("count > 1").join(target.select(*keys), keys, "left_semi")
    if row := twice.first():
        raise DuplicateKeys(f"two source rows match one target row: {row.asDict()}")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Rule], changed: Rule | None = None, check: bool = True) -> DataFrame:
    """All target and source rows; a match takes `update`, if `changed` holds, and keeps its other columns.

    Keys match by equality, so rows with a null key are never matched: they stay, and they are inserted.
    """
    if check:
        check_source(target, source, keys)
    names = target.columns
    t = target.select(F.lit(True).alias("t__"), *[F.col(c).alias(f"t_{c}") for c in names])
    s = source.select(F.lit(True).alias("s__"), *[F.col(c).alias(f"s_{c}") for c in names])
    both = t.join(s, [t[f"t_{k}"] == s[f"s_{k}"] for k in keys], "full_outer")
    old, new = (lambda c: F.col(f"t_{c}")), (lambda c: F.col(f"s_{c}"))
    matched = F.col("t__").isNotNull() & F.col("s__").isNotNull()
    if changed is not None:
        matched = matched & F.coalesce(changed(old, new), F.lit(False))
    value = lambda c: F.when(F.col("t__").isNull(), new(c)).when(matched, update[c](old, new)).otherwise(old(c)) if c in update else F.when(F.col("t__").isNull(), new(c)).otherwise(old(c))
    return both.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def expire(target: DataFrame, source: DataFrame, keys: list[str], when: Rule, update: dict[str, Rule], only: Column) -> DataFrame:
    """Update the target rows that `only` holds for and whose source row makes `when` true; nothing is inserted."""
    names = target.columns
    s = source.dropDuplicates(keys).select(F.lit(True).alias("s__"), *[F.col(c).alias(f"s_{c}") for c in source.columns])
    both = target.join(s, [target[k] == s[f"s_{k}"] for k in keys], "left")
    old, new = F.col, (lambda c: F.col(f"s_{c}"))
    hit = F.coalesce(F.col("s__") & only & when(old, new), F.lit(False))
    return both.select(*[(F.when(hit, update[f.name](old, new)).otherwise(F.col(f.name)) if f.name in update else F.col(f.name)).cast(f.dataType).alias(f.name) for f in target.schema.fields])
