"""Global row numbers and running sums without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

_ROWS = 33  # bits of a partition's own counter in monotonically_increasing_id


def laid_out(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in sorted ranges with ``__part`` (the range) and ``__at`` (the place in it), written once, so that all that reads it
    sees the same ranges."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    laid = laid.withColumn("__part", F.shiftright("__id", _ROWS)).withColumn("__at", F.col("__id").bitwiseAND((1 << _ROWS) - 1))
    return written(laid.drop("__id"), "laid")


def with_sums(laid: DataFrame, key: str | None = None, **sums: Column) -> DataFrame:
    """laid (of laid_out) with the sum of each column over all rows before a row, or over those before it that have its ``key`` (the first
    of the columns that it is sorted by).  Tables of one row a range carry the sums, and the places where keys began, over to later ranges."""
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    carried = laid.groupBy("__part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    carried = carried.select("__part", *(F.coalesce(F.sum(n).over(before), none).alias(f"__before_{n}") for n in sums))
    out = laid.withColumns({n: F.coalesce(F.sum(c).over(own), none) for n, c in sums.items()}).join(F.broadcast(carried), "__part")
    out = out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums}).drop(*(f"__before_{n}" for n in sums))
    if key is None:
        return out
    here = Window.partitionBy("__part").orderBy("__at")
    fresh = F.lag(F.struct(key)).over(here).eqNullSafe(F.struct(key))
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("__fresh", ~fresh).withColumn("__start", F.last(F.when(F.col("__fresh"), F.struct(*sums)), ignorenulls=True).over(upto))
    last = out.groupBy("__part").agg(F.max_by(F.struct(F.col(key).alias("k"), "__start"), "__at").alias("last"))
    first = last.groupBy(F.col("last.k").alias("__k")).agg(F.min("last.__start").alias("__began"))
    out = out.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("__start", F.least("__start", F.coalesce("__began", "__start")))
    return out.withColumns({n: F.col(n) - F.col("__start")[n] for n in sums}).drop("__fresh", "__start", "__k", "__began")


def numbered(df: DataFrame, *order: Column | str, name: str = "row_no") -> DataFrame:
    """df with 0, 1, 2 ... in the given order: sorted ranges are offset by the rows before them (a table with a row for each range)."""
    laid = laid_out(df, *order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return laid.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__at", "__part", "__before")


SORTED_AT_ONCE = 10_000  # rows that a limit gathers in one place


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in an order.  Few are the best of each task's best; more are numbered over sorted ranges, and stay in them."""
    if n <= SORTED_AT_ONCE:
        return df.orderBy(*order).limit(n)
    return numbered(df, *order, name="__row_no").filter(f"__row_no < {n}").drop("__row_no")
