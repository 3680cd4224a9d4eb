"""Projections, filters, joins, sets, sorts, windows and grouping sets of the stated query classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import family
from .numbering import first_rows
from .scratch import written

def _filler(kind: T.DataType, typed_null: bool) -> Column:
    """What stands for a missing column: a typed null, or 0.0 for numbers, 2025-05-30 for times and null else."""
    if typed_null or family(kind) not in ("number", "time"):
        return F.lit(None).cast(kind)
    return F.lit(0.0).cast(kind) if family(kind) == "number" else F.lit("2025-05-30").cast(kind)


def align_columns(left: DataFrame, right: DataFrame, mode: str = "pad", typed_null: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns of equal families in equal places.

    Each left column takes the first unused right column of its family, else a filler; right columns that are left over
    are dropped (``drop``) or stand at the end, with fillers on the left (``pad``).  No shuffle.
    """
    free = list(right.schema)
    out: list[Column] = []
    for f in left.schema:
        fit = next((g for g in free if family(g.dataType) == family(f.dataType) and family(f.dataType)), None)
        if fit:
            free.remove(fit)
        out.append((F.col(fit.name).cast(f.dataType) if fit else _filler(f.dataType, typed_null)).alias(f.name))
    lefts = [F.col(f.name) for f in left.schema]
    if mode == "pad":
        for g in free:
            name = unique_name(left.columns, [g.name])
            lefts.append(_filler(g.dataType, typed_null).alias(name))
            out.append(F.col(g.name).alias(name))
    return left.select(*lefts), right.select(*out)


def union_all_aligned(a: DataFrame, b: DataFrame, mode: str = "pad", typed_null: bool = True) -> DataFrame:
    return DataFrame.unionAll(*align_columns(a, b, mode, typed_null))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def limit_then_union(a: DataFrame, b: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The limit stays with the first branch."""
    return first_rows(a, n, *order).unionAll(b)


def unique_name(taken: Sequence[str], words: Sequence[str], reserved: Sequence[str] = ()) -> str:
    """A name from words, at most 20 characters, with _n when it is taken or reserved."""
    base = "_".join(words)[:20]
    used, n, name = {x.lower() for x in (*taken, *reserved)}, 0, base
    while name.lower() in used:
        n += 1
        name = f"{base[: 20 - len(str(n)) - 1]}_{n}"
    return name


def with_unique_column(df: DataFrame, words: Sequence[str], expr: Column, reserved: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(unique_name(df.columns, words, reserved), expr)


PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}


def date_part_diff(a: Column, b: Column, part: str) -> Column:
    """Difference of the parts themselves, or days between the dates for ``days``."""
    return F.datediff(a, b) if part == "days" else PARTS[part](a) - PARTS[part](b)


def date_part_filter(df: DataFrame, a: str, b: str, part: str, op: str, n: int = 0) -> DataFrame:
    d = date_part_diff(F.col(a), F.col(b), part)
    return df.filter(d == n if op == "=" else d < n)


def modal_value(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., modal): the most frequent non-null value, of equals the smallest; counted in two steps so that no group is held."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).count()
    best = F.min(F.struct((-F.col("count")).alias("c"), F.col(col).alias("v"))).alias("x")
    return counts.groupBy(*by).agg(best).select(*by, F.col("x.v").alias("modal"))


def modal_like_filter(df: DataFrame, col: str, kind: str = "like") -> DataFrame:
    """Rows containing the first word of the column's most frequent value (regex: its first backslash piece; ilike: case-blind)."""
    modal = modal_value(df, col)
    piece = F.substring_index("modal", "\\" if kind == "regex" else " ", 1)
    one = modal.select(piece.alias("__piece"))
    c = F.col(col)
    hit = {"like": F.contains(c, F.col("__piece")), "ilike": F.contains(F.upper(c), F.upper("__piece")), "regex": F.contains(c, F.col("__piece"))}[kind]
    return df.crossJoin(F.broadcast(one)).filter(hit).drop("__piece")


def modal_month_filter(df: DataFrame, col: str) -> DataFrame:
    """Rows in the month of the modal date."""
    one = modal_value(df, col).select(F.month("modal").alias("__m"))
    return df.crossJoin(F.broadcast(one)).filter(F.month(col) == F.col("__m")).drop("__m")


def _keys_between(left: str, right: str, catalog: Mapping[str, dict], reserved: Sequence[str]) -> list[tuple[str, str]] | None:
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    barred = {w.lower() for w in reserved}
    for child, parent, turned in ((left, right, False), (right, left, True)):
        for fk in catalog[child].get("foreign_key", []):
            cols, refs = listed(fk["col"]), listed(fk["ref_col"])
            if fk["ref_table"] == parent and not barred & {c.lower() for c in (*cols, *refs)}:
                return list(zip(refs, cols, strict=True)) if turned else list(zip(cols, refs, strict=True))
    return None


def fk_join(left: DataFrame, right: DataFrame, catalog: Mapping[str, dict], names: tuple[str, str], how: str = "right", reserved: Sequence[str] = ()) -> DataFrame:
    """Equi-join over the foreign key that links two tables in either direction; no usable key is an error."""
    keys = _keys_between(*names, catalog, reserved)
    if keys is None:
        raise ValueError(f"no foreign key links {names[0]} and {names[1]}")
    return left.join(right, [left[a] == right[b] for a, b in keys], how)


def pk_self_join(df: DataFrame, catalog: Mapping[str, dict], table: str, suffix: str = "_2") -> DataFrame:
    pk = catalog[table].get("primary_key")
    if not pk:
        raise ValueError(f"{table} has no primary key")
    other = df.select(*(F.col(c).alias(c if c in pk else c + suffix) for c in df.columns))
    return df.join(other, pk)


def merge_queries(a: DataFrame, b: DataFrame, catalog: Mapping[str, dict], names: tuple[str, str], how: str = "right") -> DataFrame:
    """Join over a foreign key if there is one, else UNION ALL of aligned columns."""
    return fk_join(a, b, catalog, names, how) if _keys_between(*names, catalog, ()) else union_all_aligned(a, b)


def hierarchy_levels(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, level) from the roots (null parent) down parent links, one row for every way to a root, as a recursive CTE with UNION ALL gives.

    Left out: rows without id, ids below no root, and ids whose links lead into a cycle, where the CTE would never end.

    Pointer doubling: a row holds an id, the id that is 2^k links above it and how many ways lead there; a round joins it with the rows of
    that id, which doubles the stride, so that there are as many rounds as the logarithm of the depth.  What has not ended when the stride is beyond the
    number of ids is in or below a cycle.
    """
    links = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("at")).filter("id is not null")
    now = links.groupBy("id", "at", F.when(F.col("at").isNull(), 0).otherwise(1).alias("level")).agg(F.count("*").cast("double").alias("ways"))
    stride, most = 1, None
    while True:
        now = written(now, "levels")
        open_ = now.filter("at is not null")
        if open_.isEmpty():
            ended = now
            break
        most = links.agg(F.count_distinct("id")).first()[0] if most is None else most
        if stride > most:
            ended = now.filter("at is null").join(open_.select("id").distinct(), "id", "left_anti")
            break
        above = now.toDF("at", "next", "more", "times")
        further = open_.join(above, "at").select("id", F.col("next").alias("at"), (F.col("level") + F.col("more")).alias("level"), (F.col("ways") * F.col("times")).alias("ways"))
        # an id with a parent that has no row is lost on that way only
        now = now.filter("at is null").unionByName(further).groupBy("id", "at", "level").agg(F.sum("ways").alias("ways"))
        stride *= 2
    return ended.select("id", F.col("level").cast("int").alias("level"), F.explode(F.array_repeat(F.lit(0), F.col("ways").cast("int"))).alias("n")).drop("n")


def order_by_dialect(specs: Sequence[tuple], dialect: str) -> list[Column]:
    """Sort keys from (column, 'asc'|'desc'[, 'first'|'last']): MySQL has nulls first ascending and last descending, Oracle and
    PostgreSQL the other way round; an explicit place wins."""
    out = []
    for spec in specs:
        name, way = spec[0], spec[1]
        low = dialect == "mysql"
        place = spec[2] if len(spec) > 2 and spec[2] else ("first" if (way == "asc") == low else "last")
        c = F.col(name)
        out.append({("asc", "first"): c.asc_nulls_first, ("asc", "last"): c.asc_nulls_last, ("desc", "first"): c.desc_nulls_first, ("desc", "last"): c.desc_nulls_last}[way, place]())
    return out


def order_by_position(df: DataFrame, specs: Sequence[tuple], dialect: str = "pg") -> list[Column]:
    return order_by_dialect([(df.columns[i - 1], *rest) for i, *rest in specs], dialect)


def head_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return first_rows(df, n, *order)


def cube_sets(df: DataFrame, cols: Sequence[str], aggs: Sequence[Column], grand_total: bool = False) -> DataFrame:
    """CUBE as all non-empty subsets (and the grand total if asked), in one Expand; ``gid`` tells real nulls from rolled ones."""
    out = df.cube(*cols).agg(F.grouping_id().alias("gid"), *aggs)
    return out if grand_total else out.filter(F.col("gid") < 2 ** len(cols) - 1)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(*aggs)


def group_having(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], having: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(*aggs).filter(having)


def avg_of_expr(df: DataFrame, expr: Column, by: Sequence[str], name: str = "avg_expr") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(expr).alias(name))


def topk_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rn") -> DataFrame:
    """Row numbers up to k in each group; the filter right after lets Spark limit groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(name) <= k)


def categorical_window(df: DataFrame, catalog: Mapping[str, dict], table: str, agg: Column, name: str, most: int = 3) -> DataFrame:
    """agg over a window partitioned by the table's CATEGORICAL columns (two or three; fewer if there are no more).

    A window over whole partitions is an aggregate joined back: a handful of categories would be a handful of tasks, while counts
    are summed before they are shuffled, and the join is with one row for each combination.
    """
    cols = [c["col_name"] for c in catalog[table]["cols"] if c.get("semantic", {}).get("type") == "CATEGORICAL"][:most]
    if not cols:
        raise ValueError(f"{table} has no categorical column")
    totals = df.groupBy(F.struct(*cols).alias("__by")).agg(agg.alias(name))
    return df.drop(name).withColumn("__by", F.struct(*cols)).join(totals, "__by", "left").drop("__by")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, name: str = "running") -> DataFrame:
    """Default frame: peers share the value."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order)))
