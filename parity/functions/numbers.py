"""Number expressions: tolerance, locale text, fixed masks, decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REL, ABS = 1e-6, 1e-9


def is_close(a: Column, b: Column, rel: float = REL, abs_tol: float = ABS) -> Column:
    """|a - b| <= max(rel * max(|a|, |b|), abs); NaN is close to nothing, equal infinities are; null if either is null."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.lit(float("inf"))
    near = F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).when(a == b, F.lit(True)).when((F.abs(a) == inf) | (F.abs(b) == inf), F.lit(False)).otherwise(near)


def parse_locale_number(col: Column, style: str = "point") -> Column:
    """Text to double: style ``point`` reads 1,234.5 and ``comma`` reads 1.234,5; other text gives null."""
    group, mark = (",", ".") if style == "point" else (".", ",")
    plain = F.replace(F.replace(F.trim(col), F.lit(group), F.lit("")), F.lit(mark), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def number_text(col: Column, scale: int) -> Column:
    """Fixed-scale text of a number without grouping or padding."""
    return F.replace(F.format_number(col, scale), F.lit(","), F.lit(""))


def _without_decimal(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_without_decimal(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_without_decimal(kind.keyType), _without_decimal(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _without_decimal(f.dataType), f.nullable) for f in kind])
    return kind


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Every decimal, nested ones too, as double."""
    return df.select(*(F.col(f"`{f.name}`").cast(_without_decimal(f.dataType)).alias(f.name) for f in df.schema))
