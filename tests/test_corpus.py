"""Properties of the corpus operators and small literal cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parity.operators import catalog as C
from parity.operators import corpus as K
from parity.operators import numbering
from parity.operators import relational as R
from parity.operators import retrieve as Q
from parity.operators.numbering import numbered


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [
        (1, "a", [("p", 1), ("q", 2)], ["t1"]), (2, "a", [("q", 2), ("p", 1)], ["t1", "t2"]), (3, "b", [("r", 1)], ["t2"]), (4, "b", [], []), (5, "b", [("p", 1), ("q", 1), ("r", 1)], ["t3"]),
    ]
    return spark.createDataFrame(rows, f"pair_id long, direction string, points {K.POINTS}, tables array<string>")


def ids(df, col="pair_id"):
    return sorted(r[col] for r in df.collect())


def test_filters(pairs):
    assert ids(K.pairs_within_points(pairs, ["p", "q"])) == [1, 2, 4]
    assert ids(K.pairs_using_table(pairs, "t2")) == [2, 3]
    assert ids(K.pairs_fulfilling(pairs, [("p", 1)], 3)) == [1, 2, 5]


def test_combos_ignore_order(pairs):
    assert {r["direction"]: r["combos"] for r in K.distinct_point_combos(pairs).collect()} == {"a": 1, "b": 3, None: 4}


def test_merged_counts(pairs):
    got = {r["direction"]: [tuple(p) for p in r["points"]] for r in K.merge_point_counts(pairs, "direction").collect()}
    assert got == {"a": [("p", 2), ("q", 4)], "b": [("p", 1), ("q", 1), ("r", 2)]}


def test_greedy_cover_covers_what_is_coverable(spark, pairs):
    wanted = spark.createDataFrame([("p",), ("q",), ("r",), ("nobody",)], "point string")
    got = K.greedy_cover(pairs, wanted).collect()
    assert [(r["step"], r["pair_id"], r["fresh"]) for r in got] == [(0, 5, 3)]
    assert K.greedy_cover(pairs, wanted.filter("point = 'nobody'")).count() == 0
    one = wanted.filter("point <> 'q'")
    assert [r["pair_id"] for r in K.greedy_cover(pairs.filter("pair_id <> 5"), one).collect()] == [1, 3]


def test_coverage_and_common_points(spark, pairs):
    marked = spark.createDataFrame([("p",), ("z",)], "point string")
    assert dict(K.coverage(pairs, marked).collect()) == {"p": True, "z": False}
    assert {r["pair_id"]: r["points"] for r in K.points_in_common(pairs, marked).collect()} == {1: ["p"], 2: ["p"], 5: ["p"]}


def test_relevance_order(pairs):
    got = {r["pair_id"]: (r["fresh"], r["used"], r["linked"]) for r in K.rank_relevance(pairs, ["t1"], ["t2"], ["p"]).collect()}
    assert got[2] == (1, 1, 1) and got[3] == (1, 0, 1) and got[4] == (0, 0, 0) and got[5] == (2, 0, 0)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one, two = ids(K.seeded_sample(df, 50, 3, "k"), "k"), ids(K.seeded_sample(df.repartition(7), 50, 3, "k"), "k")
    assert one == two and len(set(one)) == 50 and one != ids(K.seeded_sample(df, 50, 4, "k"), "k")
    share = K.seeded_split(df, 0.8, 3, "k").filter("part = 'train'").count() / 1000
    assert abs(share - 0.8) < 0.05


def test_drawn_lists_follow_quotas_and_weights(spark):
    rules = spark.createDataFrame([(d, f"{d}{i}") for d in "ab" for i in range(5)], "direction string, point string")
    strata = spark.createDataFrame([(1, 1, 1, 1), (2, 2, 3, 3)], "stratum int, low int, high int, weight long")
    got = K.draw_point_lists(rules, 2000, strata, [("a", 0.25), ("b", 0.75)], 5)
    rows = got.select("stratum", "direction", F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + p["num"]).alias("n")).collect()
    assert len(rows) == 2000
    assert sum(r["stratum"] == 1 for r in rows) == 500
    assert {r["n"] for r in rows if r["stratum"] == 1} == {1} and {r["n"] for r in rows if r["stratum"] == 2} == {2, 3}
    assert abs(sum(r["direction"] == "a" for r in rows) / 2000 - 0.25) < 0.05


def test_last_good_attempt(spark):
    df = spark.createDataFrame([(1, 0, "x", True), (1, 2, "y", False), (1, 1, "z", True), (2, 0, "w", False)], "q int, n int, t string, ok boolean")
    assert dict(K.last_good_attempt(df, "q", "n", "t", F.col("ok")).collect()) == {1: "z", 2: K.FAILED}


def test_append_only_new_texts(spark):
    base, extra = (spark.createDataFrame([(x,) for x in xs], "s string") for xs in (["a", "b"], ["b", "c", "c"]))
    assert ids(K.append_new(base, extra, "s"), "s") == ["a", "b", "c"]


def test_rules_with_contradicting_parameters_go(spark):
    rules = spark.createDataFrame([(1, {"pg": {"m": "x"}}), (2, {"pg": {"m": "y"}}), (3, {"mysql": {"m": "y"}}), (4, None)], "rule_id int, tag map<string,map<string,string>>")
    params = spark.createDataFrame([("pg", "m", "x")], "dialect string, param string, value string")
    assert ids(C.compatible_rules(rules, params), "rule_id") == [1, 3, 4]


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, None, 3, 9)], "x int").repartition(3)
    got = numbered(df, F.col("x").asc_nulls_last()).collect()
    assert sorted(r["row_no"] for r in got) == [0, 1, 2, 3, 4]
    assert [r["x"] for r in sorted(got, key=lambda r: r["row_no"])] == [3, 3, 5, 9, None]


def test_levels(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (9, 8)], "id int, up int")
    assert dict(R.hierarchy_levels(df, "id", "up").collect()) == {1: 0, 2: 1, 3: 2, 4: 1}


def test_joins_without_keys_are_refused(spark):
    catalog = {"a": {"foreign_key": [{"col": "order", "ref_table": "b", "ref_col": "id"}], "cols": []}, "b": {"cols": []}}
    a, b = spark.createDataFrame([(1,)], "order int"), spark.createDataFrame([(1,)], "id int")
    assert R.fk_join(a, b, catalog, ("a", "b")).count() == R.fk_join(b, a, catalog, ("b", "a")).count() == 1
    with pytest.raises(ValueError):
        R.fk_join(a, b, catalog, ("a", "b"), reserved=["ORDER"])
    with pytest.raises(ValueError):
        R.pk_self_join(a, catalog, "a")
    with pytest.raises(ValueError):
        R.categorical_window(a, catalog, "a", F.count("*"), "n")


def test_modal_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,), (None,), (None,)], "x string")
    assert R.modal_value(df, "x").collect()[0]["modal"] == "a"


def test_cosine_scores(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], items.schema)
    assert [(r["item_id"], r["score"]) for r in sorted(Q.cosine_topk(asked, items, 3).collect(), key=lambda r: r["rank"])] == [(1, 100.0), (2, 50.0), (3, 0.0)]


def test_keyword_scores(spark):
    src = spark.createDataFrame([(1, "ROUND", "")], "id long, keyword string, description string")
    tgt = spark.createDataFrame([(1, "round", "rounds"), (2, "round_up", "x"), (3, "ceil", "like round"), (4, "abs", "")], src.schema)
    assert [(r["tgt_id"], r["score"]) for r in sorted(Q.keyword_topk(src, tgt, 9).collect(), key=lambda r: r["rank"])] == [(1, 120), (2, 50), (3, 20)]


def plain_cover(pairs, wanted, links):
    """One step after another."""
    covered, used, out = set(), set(), []
    rest = {i: (set(p) & wanted, set(t)) for i, p, t in pairs}
    while True:
        near = {t for u in used for t in links.get(u, ())} - used
        key = lambda i: (-len(rest[i][0] - covered), -len(rest[i][1] & used), -len(rest[i][1] & near), i)  # noqa: B023, E731
        top = min(rest, key=key, default=None)
        if top is None or not rest[top][0] - covered:
            return out
        out.append((len(out), top, len(rest[top][0] - covered)))
        covered |= rest[top][0]
        used |= rest[top][1]
        del rest[top]


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_greedy_cover_equals_single_steps(spark, monkeypatch, most):
    """Reservations (pools of 1 and 4) give the steps of the plain form, in their order."""
    monkeypatch.setattr(K, "CANDIDATES", most)
    rng = random.Random(most)
    rows = [(i, rng.sample([f"p{n}" for n in range(25)], rng.choice([1, 2, 2, 3])), rng.sample("abcd", rng.choice([0, 1, 1, 2]))) for i in range(40)]
    wanted, links = {f"p{n}" for n in range(22)}, {"a": ["b"], "b": ["c"], "c": ["d"]}
    df = spark.createDataFrame([(i, [(p, 1) for p in ps], ts) for i, ps, ts in rows], "pair_id long, points array<struct<point:string,num:bigint>>, tables array<string>")
    got = K.greedy_cover(df, spark.createDataFrame([(w,) for w in sorted(wanted)], "point string"), links).orderBy("step").collect()
    assert [tuple(r) for r in got] == plain_cover(rows, wanted, links)


def test_greedy_cover_takes_ties_at_once(spark, monkeypatch):
    """5,000 pairs of one point each: a round of reservations each for the first, which brings the table, and for all the others."""
    rounds, once = [], K._reserved
    monkeypatch.setattr(K, "_reserved", lambda *a: rounds.append(1) or once(*a))
    df = spark.range(5000).select(F.col("id").alias("pair_id"), F.array(F.struct(F.col("id").cast("string").alias("point"), F.lit(1).cast("long").alias("num"))).alias("points"), F.array(F.lit("t")).alias("tables"))
    got = K.greedy_cover(df, df.select(F.col("points")[0]["point"].alias("point")))
    assert [r["pair_id"] for r in got.orderBy("step").collect()] == list(range(5000)) and len(rounds) <= 3


def test_samples_larger_than_a_bin(spark, monkeypatch):
    monkeypatch.setattr(K, "SORTED_AT_ONCE", 3)
    df = spark.range(3000).select(F.col("id").alias("k"))
    order = [r["k"] for r in df.orderBy(K._drawn(5, "k"), "k").collect()]
    for n in (0, 1, 77, 1500, 2999, 3000, 9000):
        assert sorted(r["k"] for r in K.seeded_sample(df, n, 5, "k").collect()) == sorted(order[:n])
    copies = df.unionAll(df).withColumn("k", F.col("k") % 2)
    assert K.seeded_sample(copies, 4000, 5, "k").count() == 4000


def test_medians_and_first_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(9)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["k"]: r["v_mid"] for r in K.corpus_stats(df, ["k"], ["v"]).collect()}
    assert got == {k: float(np.median([v for j, v in rows if j == k and v is not None])) for k in ("a", "b", None)}
    monkeypatch.setattr(numbering, "SORTED_AT_ONCE", 5)
    ids = spark.range(500)
    assert [r["id"] for r in numbering.first_rows(ids, 120, F.desc("id")).orderBy(F.desc("id")).collect()] == list(range(499, 379, -1))


def plain_levels(rows):
    below, out = {}, []
    for i, up in rows:
        below.setdefault(up, []).append(i)
    cyclic = set()
    for i, _ in rows:
        seen, todo = set(), [i]
        while todo:
            for up in [u for j, u in rows if j == todo[0] and u is not None]:
                if up == i:
                    cyclic.add(i)
                if up not in seen:
                    seen.add(up)
                    todo.append(up)
            todo.pop(0)
    bad = set(cyclic)
    for _ in rows:
        bad |= {i for i, u in rows if u in bad}
    todo = [(i, 0) for i in below.get(None, [])]
    while todo:
        i, n = todo.pop()
        if i not in bad:
            out.append((i, n))
        todo += [(j, n + 1) for j in below.get(i, []) if n < 60]
    return sorted((i, n) for i, n in out if i not in bad)


def test_levels_by_doubling(spark):
    rng = random.Random(4)
    for rows in ([(i, i - 1 if i else None) for i in range(40)], [(0, None), (1, 0), (1, 0), (2, 1), (2, 0), (3, 3), (4, 3), (5, 99), (6, 7), (7, 6), (8, 6), (8, 0)], [(i, rng.choice([None, *range(12)])) for i in range(12)]):
        got = R.hierarchy_levels(spark.createDataFrame(rows, "id long, up long"), "id", "up")
        assert sorted((r["id"], r["level"]) for r in got.collect()) == plain_levels(rows)


def test_cosine_ids_of_any_type(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in Q.cosine_topk(df.filter("id in ('a', 'c')"), df, 2).collect()}
    assert got == {("a", 1): "d", ("a", 2): "b", ("c", 1): "b", ("c", 2): "a"}


def test_cosine_skips_cells_but_no_item(spark, monkeypatch):
    """Vectors in four far directions: the same rows as by all products, with cells skipped."""
    monkeypatch.setattr(Q, "CELL", 20)
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:4]
    rows = [(int(i), (centres[i % 4] + 0.05 * rng.normal(size=6)).tolist(), "xy"[i % 2]) for i in range(300)] + [(900, [0.0] * 6, "x"), (901, None, "x"), (902, [1.0, 2.0], "x"), (903, [float("nan")] * 6, "y"), (904, [2.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    asked = df.filter("id % 7 = 0 or id = 902")
    for col in (None, "label"):
        got = {(r["query_id"], r["rank"]): r["item_id"] for r in Q.cosine_topk(asked, df, 4, col).collect()}
        want = {}
        fine = [(i, np.array(v), p) for i, v, p in rows if v and np.isfinite(v).all()]
        unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
        for q, v, p in fine:
            if q % 7 == 0 or q == 902:
                near = sorted((-float(unit(v) @ unit(w)), i) for i, w, o in fine if i != q and len(w) == len(v) and (col is None or o == p))
                want |= {(q, n + 1): i for n, (_, i) in enumerate(near[:4])}
        assert got == want
        visits = Q.cosine_cells(asked, df, 4, col).agg(F.sum("cells"), F.sum("visited")).first()
        assert visits[1] < 0.6 * visits[0]
