"""Names for SQL text: the functions that have no built-in form, and preconditions by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dates, text


def register_all(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers the library's functions for SQL text; returns their names.

    Expressions become SQL functions that Catalyst inlines; only call_arguments is an Arrow function.
    """
    plain = {
        "canon_key(t STRING) RETURNS STRING": "lower(regexp_replace(t, '\\\\s+', ''))",
        "locale_number(t STRING) RETURNS DOUBLE": "try_cast(replace(trim(t), ',', '') AS DOUBLE)",
        "unit_interval(n DECIMAL(28,6), unit STRING) RETURNS STRUCT<months: INT, micros: BIGINT>": _unit_case(),
    }
    for head, body in plain.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def call_arguments(s: pd.Series) -> pd.Series:
        return s.map(text._arguments)

    spark.udf.register(f"{prefix}call_arguments", call_arguments)
    return [prefix + h.split("(")[0] for h in plain] + [f"{prefix}call_arguments"]


def _unit_case() -> str:
    months = " ".join(f"WHEN '{u}' THEN {m}" for u, m in dates.MONTHS.items())
    micros = " ".join(f"WHEN '{u}' THEN {m}" for u, m in dates.MICROS.items())
    return f"named_struct('months', CAST(round(n * CASE upper(unit) {months} ELSE 0 END) AS INT), 'micros', CAST(round(n * CASE upper(unit) {micros} ELSE 0 END) AS BIGINT))"


def satisfies(name: str, col: Column, **how) -> Column:
    """Whether a value meets a precondition: ``date`` (of format fmt), ``interval`` (of mode), ``qstring``, ``escape`` (holds a backslash)."""
    if name == "date":
        out = dates.parse_date_multi(col, how["fmt"]).isNotNull()
    elif name == "interval":
        out = dates.parse_interval_text(col, how.get("mode", "VERBOSE")).isNotNull()
    elif name == "qstring":
        out = text.qstring(col).isNotNull()
    else:
        out = F.contains(col, F.lit("\\"))
    return F.coalesce(out, F.lit(False))
