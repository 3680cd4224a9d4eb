"""Edge cases of result verification on literal tables."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parity.functions.numbers import is_close
from parity.operators import compare as V
from parity.operators.matching import unmatched


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    ("a", "b", "near"),
    [(1.0, 1.0000005, True), (1.0, 1.00001, False), (0.0, 5e-10, True), (0.0, -0.0, True), (float("nan"), float("nan"), False), (float("inf"), float("inf"), True), (float("inf"), float("-inf"), False), (float("inf"), 1.0, False)],
)
def test_is_close(spark, a, b, near):
    assert one(spark.createDataFrame([(a, b)], "a double, b double").select(is_close(F.col("a"), F.col("b")).alias("x")))["x"] is near


def bag(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "x string")


def test_bags(spark):
    d = {(r["x"], r["diff"]) for r in V.multiset_diff(bag(spark, ["a", "a", "b", None]), bag(spark, ["a", "b", "b", None])).collect()}
    assert d == {("a", 1), ("b", -1)}
    assert one(V.multiset_equal(bag(spark, ["b", None, "a"]), bag(spark, ["a", "b", None])))["equal"]
    assert one(V.multiset_equal(bag(spark, []), bag(spark, [])))["equal"]
    assert not one(V.multiset_equal(bag(spark, []), bag(spark, ["a"])))["equal"]


def test_nested_cells_meet(spark):
    a = spark.sql("select array(2, 1) as a, map('b', 1, 'a', 2) as m, date'2020-01-01' as d")
    b = spark.sql("select array(1, 2) as a, map('a', 2, 'b', 1) as m, timestamp_ntz'2020-01-01 00:00:00' as d")
    assert one(V.multiset_equal(a, b))["equal"]


def test_numbers_of_other_types_meet(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", Decimal("2.00")), ("x", Decimal("1.00"))], "k string, v decimal(10,2)")
    assert one(V.tolerant_equal(a, b))["equal"]
    t = spark.createDataFrame([(True,)], "v boolean")
    assert one(V.tolerant_equal(t, spark.createDataFrame([(1,)], "v int")))["equal"]
    assert not one(V.tolerant_equal(a, spark.createDataFrame([("x", 1.5), ("y", 2.0)], "k string, v double")))["equal"]


def test_nulls_and_lengths(spark):
    a = spark.createDataFrame([("x", None), ("x", 1.0)], "k string, v double")
    assert one(V.tolerant_equal(a, a))["equal"]
    assert not one(V.tolerant_equal(a, a.limit(1)))["equal"]
    assert not one(V.tolerant_equal(a, a.fillna(0.0)))["equal"]


def test_ordered(spark):
    a = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "row_no long, k string, v double")
    moved = spark.createDataFrame([(0, "b", 2.0), (1, "a", 1.0)], a.schema)
    assert one(V.ordered_equal(a, a))["equal"]
    assert not one(V.ordered_equal(a, moved))["equal"]
    assert not one(V.ordered_equal(a, a.filter("row_no = 0")))["equal"]
    assert one(V.ordered_equal(a, a.filter("row_no = 0"), prefix_ok=True))["equal"]


def test_verdict_reasons(spark):
    a = spark.createDataFrame([("x", 1.0)], "k string, v double")
    none = a.filter("false")
    assert tuple(one(V.verdict(none, none))) == (True, "No result")
    assert tuple(one(V.verdict(a, a))) == (True, "ok")
    assert tuple(one(V.verdict(a, none))) == (False, "inconsistent_result")


def test_match_crosses_sorted_order(spark):
    a = spark.createDataFrame([("g", 1.0), ("g", 5.0)], "k string, v double")
    b = spark.createDataFrame([("g", 5.0000001), ("g", 9.0)], "k string, v double")
    assert [tuple(r) for r in V.tolerant_match(a, b).collect()] == [("g", 1, 1)]


def close(x, y):
    return x == y or (x is not None and y is not None and abs(x - y) <= max(1e-6 * max(abs(x), abs(y)), 1e-9))


def sorted_pairing(a, b):
    """The plain form: groups of exact cells, both lists sorted by their numbers and paired by position."""
    if len(a) != len(b):
        return False
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0.0)
    return all(x[0] == y[0] and close(x[1], y[1]) for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True))


def test_close_rows_pair_in_sorted_order(spark, monkeypatch):
    """A row that equals one of the other side may have to pair with its neighbour."""
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "v double")
    a, b = one([1.0, 1.0000008]), one([1.0000008, 1.0000016])
    assert V.tolerant_equal(a, b).first()["equal"] and V.verdict(a, b).first()["equal"]
    rows = a.withColumn("side", F.lit("a")).unionAll(b.withColumn("side", F.lit("b"))).withColumn("pair_id", F.lit(1))
    assert V.batch_verify(rows, [], ["v"]).first()["tolerant_equal"]
    monkeypatch.setattr(V, "BLOCK", 3)
    many = [1.0] * 50 + [1.0000008] * 20 + [2.0] * 7
    assert V.tolerant_equal(one(many), one([1.0] * 45 + [1.0000008] * 25 + [2.0] * 7)).first()["equal"]
    assert not V.tolerant_equal(one(many), one([1.0] * 50 + [1.0000008] * 19 + [2.0] * 8)).first()["equal"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(0, 6), st.integers(-2, 2)), min_size=1, max_size=14))
def test_pairing_equals_the_plain_form(spark, rows):
    values = lambda shift: [(k, 1 + 7e-7 * (n + (d if shift else 0))) for k, n, d in rows]
    a, b = values(False), values(True)
    frame = lambda r: spark.createDataFrame(r, "k string, v double")
    assert V.tolerant_equal(frame(a), frame(b)).first()["equal"] == sorted_pairing(a, b)


def test_match_over_stretches(spark):
    a = [("g", 1.0), ("g", 1.0), ("g", 1.0000009), ("h", 5.0), (None, 3.0), ("g", 7.0)]
    b = [("g", 1.0000008), ("g", 1.0000016), ("g", 1.0000004), ("h", 6.0), (None, 3.0000001)]
    frame = lambda r: spark.createDataFrame(r, "k string, v double")
    got = {r["k"]: (r["unmatched_a"], r["unmatched_b"]) for r in V.tolerant_match(frame(a), frame(b)).collect()}
    assert got == {"g": (1, 0), "h": (1, 1), None: (0, 0)}


NAN, INF = float("nan"), float("inf")


def plain_close(x, y):
    """Nested cells: arrays and maps in sorted order, numbers within tolerance, all else equal."""
    if isinstance(x, float) and isinstance(y, float):
        return x == y or abs(x - y) <= max(1e-6 * max(abs(x), abs(y)), 1e-9) and abs(x) != INF and abs(y) != INF
    if isinstance(x, (list, tuple)) and isinstance(y, (list, tuple)):
        return len(x) == len(y) and all(plain_close(p, q) for p, q in zip(x, y, strict=True))
    return x == y


def in_order(x):
    if isinstance(x, dict):
        return sorted((k, in_order(v)) for k, v in x.items())
    if isinstance(x, list):
        return sorted((in_order(v) for v in x), key=lambda v: (v is None, () if v is None else v))
    return tuple(in_order(v) for v in x) if isinstance(x, tuple) else x


NESTED = "a array<double>, s struct<k:string,v:double>, m map<string,double>, p array<struct<n:int,v:double>>"
STEP = st.sampled_from([0.0, 1e-9, -3e-7, 1e-4])
NUMBER = st.one_of(st.none(), st.sampled_from([1.0, 2.0, 1e6, -5.5, 0.0, INF, NAN]))


@st.composite
def two_rows(draw):
    """A nested row and the same row with its numbers moved and its arrays turned round."""

    def number():
        x = draw(NUMBER)
        return x, x if x is None or x != x or abs(x) == INF else x * (1 + draw(STEP))

    a = [number() for _ in range(draw(st.integers(0, 3)))]
    v, m, n = number(), number(), number()
    key = draw(st.sampled_from(["x", None]))
    one = ([x for x, _ in a], (key, v[0]), {"q": m[0], "b": 1.0}, [(1, n[0]), (2, 7.0)])
    two = ([y for _, y in a][::-1], (key, v[1]), {"b": 1.0, "q": m[1]}, [(2, 7.0), (1, n[1])])
    return one, two


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(two_rows(), min_size=1, max_size=4))
def test_numbers_in_nested_cells(spark, rows):
    a, b = ([r[i] for r in rows] for i in (0, 1))
    frame = lambda x: spark.createDataFrame(x, NESTED)
    ordered = [frame([r]).withColumn("row_no", F.lit(i)) for side in (a, b) for i, r in enumerate(side)]
    first, second = ordered[0], ordered[len(a)]
    for i in range(1, len(a)):
        first, second = first.unionAll(ordered[i]), second.unionAll(ordered[len(a) + i])
    got = {r["row_no"]: r["ok"] for r in V.ordered_pairs(first, second).collect()}
    want = {i: all(plain_close(in_order(p), in_order(q)) for p, q in zip(x, y, strict=True)) for i, (x, y) in enumerate(zip(a, b, strict=True))}
    assert got == want
    if all(want.values()) and len(rows) == 1:
        assert V.tolerant_equal(frame(a), frame(b)).first()["equal"]
    if not any(want.values()) and len(rows) == 1:
        assert not V.tolerant_equal(frame(a), frame(b)).first()["equal"]


def test_nested_examples(spark):
    f = lambda xs, kind: spark.createDataFrame([(x,) for x in xs], f"x {kind}")
    same = lambda x, y, kind, other=None: V.tolerant_equal(f(x, kind), f(y, other or kind)).first()["equal"]
    assert same([[1.0, 2.0]], [[2.0, 1.0000000001]], "array<double>")
    assert not same([[1.0, 2.0]], [[2.0, 1.1]], "array<double>")
    assert not same([[1.0, None]], [[None, None]], "array<double>") and same([[None, 1.0]], [[1.0, None]], "array<double>")
    assert same([[Decimal("1.50")]], [[1.5000000001]], "array<decimal(5,2)>", "array<double>")
    assert same([[1, 2]], [[2.0, 1.0]], "array<int>", "array<double>") and not same([[1]], ["1"], "array<int>", "string") and same([None], [None], "array<int>", "string")
    assert same([[[1.0], [3.0, 2.0]]], [[[2.0000001, 3.0], [1.0]]], "array<array<double>>")
    assert not same([None], [[]], "array<double>") and not same([(None,)], [None], "struct<v:double>")
    many = [[1.0, 2.0]] * 3 + [[5.0]]
    assert same(many, [[2.0, 1.0 + 1e-9]] * 3 + [[5.0]], "array<double>") and not same(many, [[1.0, 2.0]] * 2 + [[5.0]] * 2, "array<double>")


def test_nan_is_close_to_nothing(spark):
    f = lambda xs: spark.createDataFrame([("g", x) for x in xs], "k string, v double")
    assert not V.tolerant_equal(f([NAN]), f([NAN])).first()["equal"]
    assert not V.tolerant_equal(f([NAN, 1.0]), f([NAN, 1.000000001])).first()["equal"]
    assert V.multiset_equal(f([NAN]), f([NAN])).first()["equal"]
    assert tuple(V.tolerant_match(f([1.0, NAN]), f([1.0, None])).first()) == ("g", 1, 1)
    assert tuple(V.tolerant_match(f([None, INF]), f([INF, None, -INF])).first()) == ("g", 0, 1)
    rows = f([NAN]).select(F.lit(1).alias("pair_id"), F.lit("a").alias("side"), "k", "v")
    got = V.batch_verify(rows.unionAll(rows.withColumn("side", F.lit("b"))), ["k"], ["v"]).first()
    assert got["exact_equal"] and not got["tolerant_equal"]


def test_nulls_have_their_places_in_digests(spark):
    f = lambda rows: spark.createDataFrame(rows, "x int, y int, z array<int>")
    assert not V.multiset_equal(f([(1, None, [None, 1])]), f([(None, 1, [None, 1])])).first()["equal"]
    assert V.multiset_diff(f([(1, 2, [1])]), f([(1, 2, None)])).count() == 2
    zero = lambda x: spark.createDataFrame([(x, [x], (x, [(x,)]))], "x double, y array<double>, s struct<v:double,w:array<struct<u:double>>>")
    assert V.multiset_equal(zero(0.0), zero(-0.0)).first()["equal"] and not V.multiset_diff(zero(0.0), zero(-0.0)).count()
    at = lambda micro: spark.sql(f"select array(timestamp'2020-01-01 00:00:00.00000{micro}') as t, named_struct('n', timestamp_ntz'2020-01-01 00:00:00.00000{micro}') as s")
    assert V.multiset_equal(at(1), at(1)).first()["equal"] and not V.multiset_equal(at(1), at(2)).first()["equal"] and V.multiset_diff(at(1), at(2)).count() == 2


def plain_unmatched(v, na, nb):
    """Maximum matching by augmenting paths over all copies."""
    a = [i for i, n in enumerate(na) for _ in range(n)]
    b = [i for i, n in enumerate(nb) for _ in range(n)]
    owner = {}

    def grow(i, seen):
        for j, k in enumerate(b):
            if j not in seen and all(plain_close(x, y) for x, y in zip(v[a[i]], v[k], strict=True)):
                seen.add(j)
                if j not in owner or grow(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    met = sum(grow(i, set()) for i in range(len(a)))
    return len(a) - met, len(b) - met


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3), st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=3, max_size=3), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=9))
def test_maximum_matching(width, rows):
    v = np.array([[1 + 6e-7 * x for x in r[:width]] for r, _, _ in rows])
    na, nb = np.array([n for _, n, _ in rows]), np.array([n for _, _, n in rows])
    assert unmatched(v, na, nb, 1e-6, 1e-9) == plain_unmatched(v.tolist(), na, nb)


def test_matching_in_spark(spark):
    rng = random.Random(5)
    cells = lambda: (rng.choice(["g", None]), 1 + 6e-7 * rng.randrange(8), [2 + 1e-6 * rng.randrange(4)] * rng.randrange(3))
    a, b = ([cells() for _ in range(n)] for n in (60, 55))
    f = lambda rows: spark.createDataFrame(rows, "k string, v double, w array<double>")
    total = [0, 0]
    for k in ("g", None):
        for n in range(3):
            x, y = ([(r[1], *r[2]) for r in side if r[0] == k and len(r[2]) == n] for side in (a, b))
            got = plain_unmatched(x + y, [1] * len(x) + [0] * len(y), [0] * len(x) + [1] * len(y))
            total = [total[0] + got[0], total[1] + got[1]]
    rows = V.tolerant_match(f(a), f(b)).collect()
    assert [sum(r["unmatched_a"] for r in rows), sum(r["unmatched_b"] for r in rows)] == total


def closure(rows, catalog, start, keys):
    """Plain form: {table: indices of its rows}."""
    cols = {t: list(r[0]) if r else [] for t, r in rows.items()}
    held = {t: set() for t in rows}
    todo = [(start, i) for i, r in enumerate(rows[start]) if r[next(iter(cols[start]))] in keys]
    while todo:
        t, i = todo.pop()
        if i in held[t]:
            continue
        held[t].add(i)
        for fk in catalog[t].get("foreign_key", []):
            value = rows[t][i][fk["col"]]
            todo += [(fk["ref_table"], j) for j, r in enumerate(rows[fk["ref_table"]]) if value is not None and r[fk["ref_col"]] == value]
    return {t: sorted(rows[t][i]["id"] for i in h) for t, h in held.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_sample_over_cycles(spark, seed):
    rng = random.Random(seed)
    fk = lambda col, to, ref="id": {"col": col, "ref_table": to, "ref_col": ref}
    catalog = {"a": {"foreign_key": [fk("up", "a"), fk("b", "b")]}, "b": {"foreign_key": [fk("a", "a"), fk("c", "c", "code")]}, "c": {"foreign_key": [fk("b", "b")]}}
    some = lambda n: rng.choice([None, *range(n)])
    rows = {
        "a": [{"id": i, "up": some(30), "b": some(20)} for i in range(30)], "b": [{"id": i, "a": some(30), "c": some(5)} for i in range(20)],
        "c": [{"id": i, "code": i % 5, "b": some(20)} for i in range(9)],
    }
    tables = {t: spark.createDataFrame([tuple(x.values()) for x in r], ", ".join(f"{c} long" for c in r[0])) for t, r in rows.items()}
    got = V.fk_closed_sample(tables, catalog, "a", spark.createDataFrame([(3,), (7,), (None,)], "id long"))
    want = closure(rows, catalog, "a", {3, 7})
    assert {t: sorted(r["id"] for r in df.collect()) for t, df in got.items()} == {t: ids for t, ids in want.items() if ids}
    none = V.fk_closed_sample(tables, catalog, "a", spark.createDataFrame([], "id long"))
    assert {t: df.count() for t, df in none.items()} == {"a": 0}


def test_constraints_find_each_violation(spark):
    catalog = {
        "p": {"cols": [{"col_name": "id", "type": {"type_name": "INT"}, "attribute": ["NOT NULL"]}], "primary_key": ["id"]},
        "c": {"cols": [{"col_name": "k", "type": {"type_name": "ENUM", "values": ["a"]}, "attribute": ["UNIQUE"]}, {"col_name": "p_id", "type": {"type_name": "INT"}}], "foreign_key": [{"col": "p_id", "ref_table": "p", "ref_col": "id"}]},
    }
    tables = {"p": spark.createDataFrame([(1,), (1,), (None,)], "id int"), "c": spark.createDataFrame([("a", 1), ("a", 7), ("z", None)], "k string, p_id int")}
    got = {(r["tbl"], r["rule"]): r["violations"] for r in V.check_constraints(tables, catalog).collect()}
    assert got == {("p", "primary key id"): 1, ("p", "primary key not null id"): 1, ("p", "not null id"): 1, ("c", "foreign key p_id"): 1, ("c", "unique k"): 1, ("c", "enum k"): 1}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.floats(-1e6, 1e6)), min_size=1, max_size=12))
def test_shuffled_rows_are_equal_and_a_changed_cell_is_found(spark, rows):
    schema = "k string, v double"
    a = spark.createDataFrame(rows, schema)
    assert one(V.tolerant_equal(a, spark.createDataFrame(rows[::-1], schema)))["equal"]
    changed = [(rows[0][0], rows[0][1] + 1e3), *rows[1:]]
    assert not one(V.multiset_equal(a, spark.createDataFrame(changed, schema)))["equal"]


def test_dates_in_tables(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),)], "d date")
    assert one(V.multiset_equal(df, df))["equal"]


def test_two_numbers_moved_for_good_meet_no_other_order(spark, tmp_path):
    """A customer's order of a hundredth more than another one: the moved one must not be taken for it."""
    from parity.plans.registry import QUERIES

    rows = [(11, 7, "F", 100.0), (5, 7, "F", 101.0), (2, 7, "F", 50.0), (22, 8, "O", 200.0), (33, 8, "O", 202.0), (4, 9, "P", 10.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in QUERIES["v4_two_numbers"](spark, str(tmp_path)).collect()}
    assert got >= {("F", 2, 1), ("O", 2, 2)}
