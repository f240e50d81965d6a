"""SQL over a store: its tables as views under their own names, the spectrum functions, and SQL files with parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import spectrum_magnitude
from .store import Store


def register_functions(spark: SparkSession) -> None:
    """fft_magnitude(array<double>) and fft_freqs(array<double>, double) for this session."""
    spark.udf.register("fft_magnitude", spectrum_magnitude)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fft_freqs(v ARRAY<DOUBLE>, rate DOUBLE) RETURNS ARRAY<DOUBLE> RETURN transform(sequence(0, size(v) DIV 2), k -> k * rate / size(v))")


def register_views(store: Store) -> None:
    """Databases and views such as `marts.accel_hourly_summary` over the last commit; call it again to see a later one."""
    spark = store.spark
    _, state = store._latest()
    for name, schema in store.tables.items():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.split('.')[0]}")
        columns = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
        parts = [f"SELECT {columns} FROM parquet.`{store.root}/{e['path']}`" for e in state.get(name, [])]
        empty = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS " + (" UNION ALL ".join(parts) or f"SELECT {empty} WHERE false"))


#: Quoted texts, quoted names and comments, within which a semicolon or a colon means nothing.
_QUOTED = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/"""


def statements(text: str) -> list[str]:
    """The statements of a SQL text, divided by semicolons; empty ones and comments alone are left out."""
    parts = [""]
    for piece in re.findall(rf"{_QUOTED}|;|[^;'\"`/-]+|[/-]", text, re.S):
        if piece == ";":
            parts.append("")
        else:
            parts[-1] += piece
    return [p.strip() for p in parts if re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.S).strip()]


def run_sql(spark: SparkSession, text: str, params: dict[str, object] | None = None) -> DataFrame | None:
    """Run the statements of a text one after another; the result of the last.

    `:name` in them is a parameter of the engine, so a value is a value whatever it holds, and a name without one is an
    error. A list is an array: `explode(:files)`.
    """
    out = None
    for statement in statements(text):
        names = set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", re.sub(_QUOTED, " ", statement, flags=re.S)))
        out = spark.sql(statement, args={k: v for k, v in (params or {}).items() if k in names})
    return out


def run_sql_file(spark: SparkSession, path: str, params: dict[str, object] | None = None) -> DataFrame | None:
    with open(path, encoding="utf-8") as lines:
        return run_sql(spark, lines.read(), params)
