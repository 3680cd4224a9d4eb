"""Nested cells: canonical form, arrays and points kept as text, XML paths, record fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canon_nested(col: Column, kind: T.DataType) -> Column:
    """A comparable form: arrays sorted, maps as entries sorted by key, dates as midnight timestamps, recursively."""
    if isinstance(kind, T.DateType):
        return col.cast("timestamp_ntz")
    if isinstance(kind, T.ArrayType):
        return F.array_sort(F.transform(col, lambda x: canon_nested(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), canon_nested(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(col), entry))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(canon_nested(col[f.name], f.dataType).alias(f.name) for f in kind)))
    return col


def canon_rows(df: DataFrame) -> DataFrame:
    return df.select(*(canon_nested(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


EXACT_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _number(kind: T.DataType) -> bool:
    return isinstance(kind, (*EXACT_NUMBERS, T.FloatType, T.DoubleType))


def _fields(one: T.DataType, two: T.DataType) -> bool:
    return isinstance(one, T.StructType) and isinstance(two, T.StructType) and len(one) == len(two)


def has_loose(one: T.DataType, two: T.DataType) -> bool:
    """Is there a number in cells of these types, at any depth, that is not integral on both sides?"""
    if _number(one) and _number(two):
        return not (isinstance(one, EXACT_NUMBERS) and isinstance(two, EXACT_NUMBERS))
    if isinstance(one, T.ArrayType) and isinstance(two, T.ArrayType):
        return has_loose(one.elementType, two.elementType)
    return _fields(one, two) and any(has_loose(f.dataType, g.dataType) for f, g in zip(one, two, strict=True))


def as_number(col: Column, kind: T.DataType, to: str) -> Column:
    return col.cast("int").cast(to) if isinstance(kind, T.BooleanType) else col.cast(to)


def loose_parts(col: Column, mine: T.DataType, other: T.DataType) -> tuple[Column, Column | None]:
    """A canonical cell in two parts: its shape (types, lengths, nulls and exact leaves) and the vector of its tolerant numbers, or None
    if its type has none.

    Cells are close if their shapes are equal and their vectors close, place by place.  Elements of an array are ordered by shape and
    then by vector, so that close arrays meet whatever their order was.  Cells of different kinds are never equal unless both are null.
    """
    none = F.array().cast("array<double>")
    if _number(mine) and _number(other):
        if not has_loose(mine, other):
            return as_number(col, mine, "long"), None
        return col.isNull(), F.when(col.isNull(), none).otherwise(F.array(as_number(col, mine, "double")))
    if isinstance(mine, T.ArrayType) and isinstance(other, T.ArrayType):
        if not has_loose(mine, other):
            return F.array_sort(F.transform(col, lambda x: loose_parts(x, mine.elementType, other.elementType)[0])), None

        def both(x: Column) -> Column:
            shape, vector = loose_parts(x, mine.elementType, other.elementType)
            return F.struct(shape.alias("s"), vector.alias("v"))

        items = F.array_sort(F.transform(col, both))
        return F.transform(items, lambda x: x["s"]), F.coalesce(F.flatten(F.transform(items, lambda x: x["v"])), none)
    if _fields(mine, other):
        parts = [loose_parts(col[f.name], f.dataType, g.dataType) for f, g in zip(mine, other, strict=True)]
        shape = F.when(col.isNotNull(), F.struct(*(s.alias(f"f{i}") for i, (s, _) in enumerate(parts))))
        vectors = [v for _, v in parts if v is not None]
        return shape, F.concat(*vectors) if vectors else None
    times = (T.TimestampType, T.TimestampNTZType)
    texts = (T.StringType, T.CharType, T.VarcharType)
    if type(mine) is type(other) or any(isinstance(mine, k) and isinstance(other, k) for k in (times, texts)):
        return col, None
    return F.when(col.isNotNull(), F.lit(mine.typeName())), None


def array_from_text(col: Column, element: str = "string") -> Column:
    return F.from_json(col, f"array<{element}>")


def array_to_text(col: Column) -> Column:
    return F.to_json(col)


def point_from_json(col: Column) -> Column:
    return F.from_json(col, "longitude double, latitude double")


def point_text(point: Column, dialect: str = "pg") -> Column:
    """``POINT(x y)``; MySQL puts the latitude first; a null part gives null."""
    x, y = point["longitude"], point["latitude"]
    one, two = (y, x) if dialect == "mysql" else (x, y)
    return F.concat(F.lit("POINT("), one.cast("string"), F.lit(" "), two.cast("string"), F.lit(")"))


def xml_values(col: Column, path: str) -> Column:
    return F.xpath(col, F.lit(path))


def xml_count(col: Column, path: str) -> Column:
    """How many nodes a path finds; a path already wrapped in ``count( )`` is taken without it."""
    path = path.strip()
    inner = path[6:-1].strip() if path.startswith("count(") and path.endswith(")") else path
    return F.xpath_int(col, F.lit(f"count({inner})"))


def item_fingerprint(df: DataFrame, name: str = "fingerprint") -> DataFrame:
    """df with the SHA-256 of each record's JSON, keys in order."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))
