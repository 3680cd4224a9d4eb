"""Result verification: bags and lists of rows compared exactly or within a tolerance."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.nested import as_number, canon_rows, has_loose, loose_parts
from parity.functions.numbers import ABS, REL, decimals_to_double, is_close

from .matching import as_vector, stretches, unmatched, whole_keys
from .numbering import laid_out, with_sums
from .scratch import shared_folder, written

BUCKETS = 1 << 14  # of rows by a hash of their exact cells: as many sums are all that equal tables shuffle
BLOCK = 1 << 16  # positions of a group's sorted lists that are paired in one window
_PIECES = ((0, 22), (22, 21), (43, 21))  # (shift, bits) of a 64-bit hash; sums of so few bits hold for 2^41 rows


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # whole microseconds


def _zeroed(col: Column, kind: T.DataType) -> Column:
    """-0.0 as 0.0, at any depth, as grouping has it."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return col + F.lit(0.0).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _zeroed(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(_zeroed(col[f.name], f.dataType).alias(f.name) for f in kind)))
    return col


def _hash(seed: int, cells: Sequence[tuple[Column, T.DataType]]) -> Column:
    """64 bits of a row's cells; nulls have their places, nested cells are hashed as JSON."""
    parts = [F.lit(seed)]
    for col, kind in cells:
        col = _zeroed(col, kind)
        parts += [col.isNull(), F.to_json(F.struct(col.alias("c")), _JSON) if isinstance(kind, (T.ArrayType, T.StructType)) else col]
    return F.xxhash64(*parts)


def _digest_sums(cells: Sequence[tuple[Column, T.DataType]], sign: Column) -> list[Column]:
    """Sums over rows of the pieces of two hashes: a's rows count up and b's down, so that equal bags leave zeros, whatever their order."""
    mask = lambda h, at, n: F.shiftrightunsigned(h, at).bitwiseAND((1 << n) - 1)
    return [F.sum(mask(_hash(seed, cells), at, n) * sign).alias(f"d{seed}_{at}") for seed in (1, 2) for at, n in _PIECES]


_OFF = " or ".join(f"d{seed}_{at} <> 0" for seed in (1, 2) for at, _ in _PIECES)


def _bucket(cells: Sequence[tuple[Column, T.DataType]]) -> Column:
    return F.pmod(_hash(3, cells), F.lit(BUCKETS)).alias("__bucket")


def _both_sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[tuple[Column, T.DataType]]]:
    side = lambda df, n: canon_rows(df).withColumn("__side", F.lit(n).cast("long"))
    rows = side(a, 1).unionAll(side(b.toDF(*a.columns), -1))
    cells = [(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema if f.name != "__side"]
    return rows.withColumn("__bucket", _bucket(cells)), cells


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with ``diff`` = copies in a minus copies in b.  NaN is one value here, and so are 0.0 and -0.0.

    A first pass sums digests of 128 bits by bucket; only rows of buckets that differ are read again and counted as they are, pre-aggregated.
    What is broadcast is at most 16,384 bucket numbers.
    """
    rows, cells = _both_sides(a, b)
    off = rows.groupBy("__bucket").agg(*_digest_sums(cells, F.col("__side"))).filter(_OFF).select("__bucket")
    cols = [c for c, _ in cells]
    return rows.join(F.broadcast(off), "__bucket", "left_semi").groupBy(*cols).agg(F.sum("__side").alias("diff")).filter("diff <> 0")


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: equal.  Digests alone decide: bags that differ have other sums but for a chance of 2^-128."""
    rows, cells = _both_sides(a, b)
    sums = rows.groupBy("__bucket").agg(*_digest_sums(cells, F.col("__side")))
    return sums.agg((F.count_if(F.expr(_OFF)) == 0).alias("equal"))


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Both sides canonical under a's names: the exact columns (among them the shapes of nested cells), and the tolerant ones, which are doubles
    or, for nested cells, vectors of them named ``__numbers_i``.

    A number is tolerant unless it is integral on both sides; a boolean counts as a number if the other side is one.
    """
    a, b = canon_rows(decimals_to_double(a)), canon_rows(decimals_to_double(b.toDF(*a.columns)))
    exact, tolerant, left, right = [], [], [], []
    for i, (f, g) in enumerate(zip(a.schema, b.schema, strict=True)):
        flat = not isinstance(f.dataType, (T.ArrayType, T.StructType))
        if flat and has_loose(f.dataType, g.dataType):
            for side, kind in ((left, f.dataType), (right, g.dataType)):
                side.append(as_number(F.col(f"`{f.name}`"), kind, "double").alias(f.name))
            tolerant.append(f.name)
            continue
        exact.append(f.name)
        for side, one, two in ((left, f.dataType, g.dataType), (right, g.dataType, f.dataType)):
            shape, vector = loose_parts(F.col(f"`{f.name}`"), one, two)
            side.append(shape.alias(f.name))
            if vector is not None:
                side.append(vector.alias(f"__numbers_{i}"))
        if vector is not None:
            tolerant.append(f"__numbers_{i}")
    return a.select(*left), b.select(*right), exact, tolerant


def _close(x: Column, y: Column, kind: T.DataType, rel: float, abs_tol: float) -> Column:
    """Tolerant cells: null meets null only; vectors are of one length, since their shapes are equal."""
    if isinstance(kind, T.ArrayType):
        return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda u, v: F.coalesce(is_close(u, v, rel, abs_tol), F.lit(False))), lambda ok: ok)
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(is_close(x, y, rel, abs_tol))


def _has_nan(df: DataFrame, names: Sequence[str]) -> Column:
    found = F.lit(False)
    for c in names:
        col = F.col(f"`{c}`")
        found = found | (F.exists(col, F.isnan) if isinstance(df.schema[c].dataType, T.ArrayType) else F.coalesce(F.isnan(col), F.lit(False)))
    return found


def _cells(rows: DataFrame, exact: Sequence[str], loose: Sequence[str], in_a: Column) -> DataFrame:
    """(g, l0, l1, ..., in_a): the exact cells as one value, the tolerant ones, and the side."""
    g = F.struct(F.lit(0).alias("all"), *(F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(exact))).alias("g")
    return rows.select(g, *(F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(loose)), in_a.alias("in_a"))


def _digested(rows: DataFrame, *by: Column) -> DataFrame:
    """Digest sums of (g, l0, ..., in_a) by bucket of g and further columns, with rows_a, rows_b and the number of rows that hold a NaN."""
    names = [c for c in rows.columns if c not in ("g", "in_a")]
    exact = [(F.col("g")[f.name], f.dataType) for f in rows.schema["g"].dataType]
    cells = exact + [(F.col(c), rows.schema[c].dataType) for c in names]
    sums = _digest_sums(cells, F.when(F.col("in_a"), 1).otherwise(-1).cast("long"))
    return rows.groupBy(*by, _bucket(exact)).agg(*sums, F.count_if("in_a").alias("rows_a"), F.count_if(~F.col("in_a")).alias("rows_b"), F.count_if(_has_nan(rows, names)).alias("nan"))


def _paired(rows: DataFrame, off: DataFrame, rel: float, abs_tol: float) -> DataFrame:
    """(g, ok) of rows (g, l0, l1, ..., in_a), for the buckets ``off`` whose digests differ or that hold a NaN; the others are equal.

    Rows are counted once, and groups whose bags are wholly equal are left out.  One whose sides differ in size has one row that is not ok.
    In the others both sides' whole lists, sorted by their numbers, are paired by position.  A row with many copies is a run of positions
    and is never multiplied; runs are cut at blocks of positions, and wherever a run begins its values meet the other side's there.
    """
    names = [c for c in rows.columns if c not in ("g", "in_a")]
    kinds = {c: rows.schema[c].dataType for c in names}
    exact = [(F.col("g")[f.name], f.dataType) for f in rows.schema["g"].dataType]
    todo = rows.withColumn("__bucket", _bucket(exact)).join(F.broadcast(off.select("__bucket")), "__bucket", "left_semi")
    bags = todo.groupBy("g", *names).agg(F.count_if("in_a").alias("na"), F.count_if(~F.col("in_a")).alias("nb"))
    laid = laid_out(bags, "g", *names)
    odd = (F.col("na") != F.col("nb")) | _has_nan(bags, names)
    sizes = laid.groupBy("g").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.max(odd).alias("off")).filter("off")
    uneven = sizes.filter("ta <> tb").select("g", F.lit(False).alias("ok"))
    placed = with_sums(laid, key="g", pa=F.col("na"), pb=F.col("nb")).join(sizes.filter("ta = tb").select("g"), "g", "left_semi")
    cells, none = F.struct(F.lit(0).alias("row"), *names), F.lit(None)

    def runs(at: str, n: str, mine: str) -> DataFrame:
        rows = placed.filter(F.col(n) > 0).select("g", F.col(at).alias("at"), F.col(n).alias("n"), cells.alias("cells"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("n") - 1) / BLOCK))))
        kind = rows.schema["cells"].dataType
        return rows.select("g", "block", F.greatest("at", F.col("block") * BLOCK).alias("at"), *((F.col("cells") if c == mine else none.cast(kind)).alias(c) for c in ("x", "y")))

    both = runs("pa", "na", "x").unionByName(runs("pb", "nb", "y"))
    w = Window.partitionBy("g", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.select("g", F.last("x", ignorenulls=True).over(w).alias("x"), F.last("y", ignorenulls=True).over(w).alias("y"))
    ok = F.lit(True)
    for c in names:
        ok = ok & _close(F.col("x")[c], F.col("y")[c], kinds[c], rel, abs_tol)
    return met.select("g", F.coalesce(ok, F.lit(False)).alias("ok")).unionByName(uneven)


def tolerant_pairs(a: DataFrame, b: DataFrame, rel: float = REL, abs_tol: float = ABS) -> DataFrame:
    """(ok) for each run of paired rows where bags are not equal as they are: rows are grouped by their exact cells, sorted by their
    numbers inside a group and paired by position; groups of different sizes are not ok.  Numbers in arrays, structs and maps count as
    tolerant cells too.  A null meets only a null, and a NaN nothing, so that a row with a NaN is never ok."""
    a, b, exact, loose = _aligned(a, b)
    rows = _cells(a.withColumn("__a", F.lit(True)).unionAll(b.withColumn("__a", F.lit(False))), exact, loose, F.col("__a"))
    return _paired(rows, _digested(rows).filter(f"{_OFF} or nan > 0"), rel, abs_tol).select("ok")


def tolerant_equal(a: DataFrame, b: DataFrame, rel: float = REL, abs_tol: float = ABS) -> DataFrame:
    """One row: equal, order-free and within tolerance."""
    return tolerant_pairs(a, b, rel, abs_tol).agg((F.count(F.when(~F.col("ok"), 1)) == 0).alias("equal"))


def ordered_pairs(a: DataFrame, b: DataFrame, row_no: str = "row_no", rel: float = REL, abs_tol: float = ABS, prefix_ok: bool = False) -> DataFrame:
    """(row_no, ok): row i of a against row i of b; a row beyond the other's end is not ok unless prefix_ok.  Nested cells, nulls and NaN
    as in tolerant_pairs."""
    one, two, exact, loose = _aligned(a, b)
    y = two.select(F.col(row_no).alias("__no"), *(F.col(f"`{c}`").alias(f"__y_{c}") for c in one.columns if c != row_no))
    joined = one.join(y, F.col(row_no) == F.col("__no"), "full")
    ok = F.lit(True)
    for c in one.columns:
        if c != row_no:
            x, y = F.col(f"`{c}`"), F.col(f"`__y_{c}`")
            ok = ok & (_close(x, y, one.schema[c].dataType, rel, abs_tol) if c in loose else x.eqNullSafe(y))
    alone = F.col(row_no).isNull() | F.col("__no").isNull()
    return joined.select(F.coalesce(row_no, "__no").alias("row_no"), F.when(alone, F.lit(prefix_ok)).otherwise(ok).alias("ok"))


def ordered_equal(a: DataFrame, b: DataFrame, **how) -> DataFrame:
    """One row: equal, row by row."""
    return ordered_pairs(a, b, **how).agg((F.count(F.when(~F.col("ok"), 1)) == 0).alias("equal"))


CUTS = 2  # numbers of a row by which stretches are cut in Spark


def tolerant_match(a: DataFrame, b: DataFrame, rel: float = REL, abs_tol: float = ABS) -> DataFrame:
    """Rows that a maximum matching within the tolerance leaves over, for each group of exact cells that is not equal as it is:
    (exact cells, unmatched_a, unmatched_b).  Sorted order may misalign near rows of several numbers; a matching cannot.

    Only groups in buckets whose digests differ are looked at, with all their rows: a row that both sides have may have to give way.  They are
    cut into stretches wherever the first number, and then the second, makes a step beyond the tolerance; wholly equal
    stretches are done.  A stretch that is left is one task: of one number it is matched in one sorted pass, of more along augmenting
    paths, holding rows but no pairs.  It is as long as the data is dense within the tolerance; that is its only bound.  Nulls meet
    nulls, a row with a NaN is left over.
    """
    a, b, exact, loose = _aligned(a, b)
    rows = _cells(a.withColumn("__a", F.lit(True)).unionAll(b.withColumn("__a", F.lit(False))), exact, loose, F.col("__a"))
    off = _digested(rows).filter(f"{_OFF} or nan > 0").select("__bucket")
    cells = [(F.col("g")[f.name], f.dataType) for f in rows.schema["g"].dataType]
    nulls, v = as_vector([(c, isinstance(rows.schema[c].dataType, T.ArrayType)) for c in rows.columns if c[0] == "l"])
    todo = rows.withColumn("__bucket", _bucket(cells)).join(F.broadcast(off), "__bucket", "left_semi").select("g", F.struct("g", nulls.alias("nulls")).alias("k"), v.alias("v"), "in_a")
    bags = written(todo.groupBy("g", "k", "v").agg(F.count_if("in_a").alias("na"), F.count_if(~F.col("in_a")).alias("nb")), "bags")
    nan = F.exists("v", F.isnan)
    groups = bags.groupBy("g").agg(F.max((F.col("na") != F.col("nb")) | nan).alias("off"), F.sum(F.when(nan, F.col("na")).otherwise(0)).alias("a0"), F.sum(F.when(nan, F.col("nb")).otherwise(0)).alias("b0")).filter("off")
    longest = bags.agg(F.max(F.size("v"))).first()[0] or 0
    cut = bags.filter(~nan).join(groups.select("g"), "g", "left_semi").withColumn("key", F.col("k"))
    for i in range(max(1, min(CUTS, longest))):
        cut = stretches(cut, "key", i, rel, abs_tol).drop("key").withColumnRenamed("stretch", "key")
    # a group's cells are told apart by the number of their stretch, so that no nested value enters a task
    known = cut.groupBy("key").agg(F.first("g").alias("g"), F.max(F.col("na") != F.col("nb")).alias("differs")).filter("differs")
    left = cut.select("key", "v", "na", "nb").join(known.select("key"), "key", "left_semi")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            keys, many = np.asarray(rows.column("key")), np.diff(np.asarray(rows.column("v").offsets))
            v, na, nb = np.asarray(rows.column("v").flatten()), np.asarray(rows.column("na")), np.asarray(rows.column("nb"))
            at, cuts = np.concatenate([[0], np.cumsum(many)]), np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            found = [unmatched(v[at[i] : at[j]].reshape(j - i, -1), na[i:j], nb[i:j], rel, abs_tol) for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[cuts]), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=["key", "ua", "ub"])

    matched = left.repartition("key").sortWithinPartitions("key").mapInArrow(match, "key long, ua long, ub long").join(known, "key").groupBy(F.col("g").alias("h")).agg(F.sum("ua").alias("ua"), F.sum("ub").alias("ub"))
    done = groups.join(matched, F.col("g").eqNullSafe(F.col("h")), "left")
    total = lambda n, u: (F.col(n) + F.coalesce(u, F.lit(0))).alias(f"unmatched_{n[0]}")
    return done.select(*(F.col("g")[f"e{i}"].alias(c) for i, c in enumerate(exact)), total("a0", "ua"), total("b0", "ub"))


def verdict(a: DataFrame, b: DataFrame, ordered: bool = False, **how) -> DataFrame:
    """One row (equal, reason): both empty is equal with reason ``No result``, a difference ``inconsistent_result``, else ``ok``."""
    pairs = ordered_pairs(a, b, **how) if ordered else tolerant_pairs(a, b, **how)
    bad = pairs.agg(F.count(F.when(~F.col("ok"), 1)).alias("bad"))
    some = a.limit(1).select(F.lit(1).alias("x")).unionAll(b.limit(1).select(F.lit(1).alias("x"))).agg(F.count("*").alias("some"))
    equal = F.col("bad") == 0
    return bad.crossJoin(some).select(equal.alias("equal"), F.when(F.col("some") == 0, "No result").when(equal, "ok").otherwise("inconsistent_result").alias("reason"))


def batch_verify(results: DataFrame, exact: list[str], loose: list[str], rel: float = REL, abs_tol: float = ABS) -> DataFrame:
    """Verdict per pair over rows (pair_id, side 'a' or 'b', cells): rows_a, rows_b, exact_equal, tolerant_equal, reason.

    Digests are summed by pair and bucket of exact cells, so that one huge pair spreads over all tasks and equal pairs are done after one
    pass; rows of the other buckets are counted and, where groups differ, paired.  exact_equal takes NaN for equal, tolerant_equal does not.
    """
    rows = _cells(results, ["pair_id", *exact], loose, F.col("side") == "a")
    pair = F.col("g")["e0"].alias("pair_id")
    stats = written(_digested(rows, pair), "stats")
    sums = [c for c in stats.columns if c not in ("pair_id", "__bucket")]
    sizes = stats.groupBy("pair_id").agg(*(F.sum(c).alias(c) for c in ("rows_a", "rows_b")), F.count_if(F.expr(_OFF)).alias("off"))
    off = stats.groupBy("__bucket").agg(*(F.max(F.abs(c)).alias(c) for c in sums)).filter(f"{_OFF} or nan > 0")
    bad = _paired(rows, off, rel, abs_tol).groupBy(pair).agg(F.count_if(~F.col("ok")).alias("bad"))
    out = sizes.join(bad, "pair_id", "left").withColumn("tolerant_equal", F.coalesce("bad", F.lit(0)) == 0)
    reason = F.when(F.col("rows_a") + F.col("rows_b") == 0, "No result").when(F.col("tolerant_equal"), "ok").otherwise("inconsistent_result")
    return out.select("pair_id", "rows_a", "rows_b", (F.col("off") == 0).alias("exact_equal"), "tolerant_equal", reason.alias("reason"))


def combined_verdict(main: DataFrame, sample: DataFrame) -> DataFrame:
    """(pair_id, equal, reason): equal on both databases; a pair that either lacks is not equal; reasons other than ok are joined."""
    side = lambda df, n: df.select("pair_id", F.col("tolerant_equal").alias(f"e{n}"), F.col("reason").alias(f"r{n}"))
    both = side(main, 1).join(side(sample, 2), "pair_id", "full")
    said = lambda n: F.when(F.col(f"r{n}").isNull(), "not run").when(F.col(f"r{n}") != "ok", F.col(f"r{n}"))
    return both.select("pair_id", (F.coalesce("e1", F.lit(False)) & F.coalesce("e2", F.lit(False))).alias("equal"), F.concat_ws("; ", said(1), said(2)).alias("reason"))


def nonempty_and_equal(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("rows_a > 0 and tolerant_equal")


def fk_closed_sample(tables: Mapping[str, DataFrame], catalog: Mapping[str, dict], start: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The rows of table ``start`` with the given keys, and what foreign keys reach from them, as a small valid database.

    A fixpoint over wanted keys: in each round every table hands on the keys that its rows newly wanted in the round before
    refer to; keys that were wanted before are left out, and the rounds end when none is new.  So tables may refer to themselves, to each
    other or over many paths; a key is followed once, and there are as many rounds as the longest chain of rows has links.  Each round's keys
    are written.  Tables keep their rows as they are, copies too; a null key refers to nothing.
    """
    spark = keys.sparkSession
    base = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"
    kept: dict[tuple[str, tuple[str, ...]], list[str]] = {}  # (table, its columns): where the wanted keys of each round are
    schemas = {}

    def keep(table: str, cols: tuple[str, ...], wanted: DataFrame) -> DataFrame | None:
        path = f"{base}/{uuid.uuid4().hex}"
        wanted.write.parquet(path)
        got = spark.read.schema(wanted.schema).parquet(path)
        if got.isEmpty():
            return None
        kept.setdefault((table, cols), []).append(path)
        schemas[table, cols] = wanted.schema
        return got

    def all_of(table: str, cols: tuple[str, ...]) -> DataFrame:
        return spark.read.schema(schemas[table, cols]).parquet(*kept[table, cols])

    first = keep(start, tuple(keys.columns), keys.dropna().distinct())
    new = {(start, tuple(keys.columns)): first} if first is not None else {}
    while new:
        asked: dict[tuple[str, tuple[str, ...]], DataFrame] = {}
        for child in dict.fromkeys(t for t, _ in new):
            rows = _rows_with(tables[child], {cols: df for (t, cols), df in new.items() if t == child})
            for fk in catalog[child].get("foreign_key", []):
                cols, refs = _listed(fk["col"]), tuple(_listed(fk["ref_col"]))
                kinds = {f.name: f.dataType for f in tables[fk["ref_table"]].schema}
                want = rows.select(*(F.col(c).cast(kinds[r]).alias(r) for c, r in zip(cols, refs, strict=True))).dropna().distinct()
                at = (fk["ref_table"], refs)
                asked[at] = asked[at].unionByName(want).distinct() if at in asked else want
        new = {}
        for (table, refs), want in asked.items():
            if (table, refs) in kept:
                want = want.join(all_of(table, refs), list(refs), "left_anti")
            if (got := keep(table, refs, want)) is not None:
                new[table, refs] = got
    out = {}
    for table in dict.fromkeys([start, *(t for t, _ in kept)]):
        sets = {cols: all_of(t, cols) for t, cols in kept if t == table}
        out[table] = _rows_with(tables[table], sets) if sets else tables[table].limit(0)
    return out


def _rows_with(rows: DataFrame, keys: Mapping[tuple[str, ...], DataFrame]) -> DataFrame:
    """The rows that hold one of the (distinct) keys in some set of columns; the table is read once."""
    if len(keys) == 1:
        (cols, df), = keys.items()
        return rows.join(df, list(cols), "left_semi").select(*rows.columns)
    held = rows
    for i, (cols, df) in enumerate(keys.items()):
        held = held.join(df.withColumn(f"__in_{i}", F.lit(True)), list(cols), "left")
    return held.filter(F.coalesce(*(F.col(f"__in_{i}") for i in range(len(keys))), F.lit(False))).select(*rows.columns)


def _listed(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def check_constraints(tables: Mapping[str, DataFrame], catalog: Mapping[str, dict]) -> DataFrame:
    """(tbl, rule, violations) for every declared primary key, foreign key, NOT NULL, UNIQUE and ENUM rule."""
    found = []
    say = lambda df, t, rule: df.agg(F.count("*").alias("violations")).select(F.lit(t).alias("tbl"), F.lit(rule).alias("rule"), "violations")
    for t, spec in catalog.items():
        df = tables[t]
        if pk := spec.get("primary_key"):
            found.append(say(df.groupBy(*pk).count().filter("count > 1"), t, f"primary key {','.join(pk)}"))
            null = F.lit(False)
            for c in pk:
                null = null | F.col(c).isNull()
            found.append(say(df.filter(null), t, f"primary key not null {','.join(pk)}"))
        for fk in spec.get("foreign_key", []):
            cols, refs = _listed(fk["col"]), _listed(fk["ref_col"])
            parent = tables[fk["ref_table"]].select(*(F.col(r).alias(c) for c, r in zip(cols, refs, strict=True)))
            found.append(say(df.dropna(subset=cols).join(parent, cols, "left_anti"), t, f"foreign key {','.join(cols)}"))
        for col in spec["cols"]:
            c, marks = col["col_name"], col.get("attribute", [])
            if "NOT NULL" in marks:
                found.append(say(df.filter(F.col(c).isNull()), t, f"not null {c}"))
            if "UNIQUE" in marks:
                found.append(say(df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1"), t, f"unique {c}"))
            if values := col["type"].get("values"):
                found.append(say(df.filter(F.col(c).isNotNull() & ~F.col(c).isin(*values)), t, f"enum {c}"))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out
