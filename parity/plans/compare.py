"""Queries of the verification operators."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.operators import compare as V
from parity.operators.numbering import numbered

from .common import CATALOG, query, table

LOOSE_PAIR = "abs(x - y) <= greatest(1e-6 * greatest(abs(x), abs(y)), 1e-9)"


def revenue_two_ways(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Revenue per priority: join then group, and group then join."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    a = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.sum(amount).alias("revenue"))
    by_order = lines.groupBy("l_orderkey").agg(F.sum(amount).alias("r"))
    b = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg((F.sum("r") * (1 + 1e-9)).alias("revenue"))
    return a, b


def line_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    dropped = a.filter("l_orderkey % 97 <> 0")
    return a, dropped.unionAll(dropped.filter("l_orderkey % 89 = 0"))


V1_SQL = """
WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
 b AS (SELECT l_orderkey, l_linenumber, l_returnflag, n * CASE WHEN l_orderkey % 97 = 0 THEN 0 WHEN l_orderkey % 89 = 0 THEN 2 ELSE 1 END AS n FROM a)
SELECT l_orderkey, l_linenumber, l_returnflag, CAST(a.n - b.n AS BIGINT) AS diff FROM a JOIN b USING (l_orderkey, l_linenumber, l_returnflag) WHERE a.n <> b.n
"""


@query("v1_multiset_diff", V1_SQL)
def v1_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.multiset_diff(*line_bags(spark, sf_dir))


@query("v1_multiset_equal", f"SELECT count(*) = 0 AS equal FROM ({V1_SQL})")
def v1_multiset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.multiset_equal(*line_bags(spark, sf_dir))


def moved_orders(spark: SparkSession, sf_dir: str, step: float) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    return a, a.withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") * (1 + step)).otherwise(F.col("o_totalprice")))


@query(
    "v2_tolerant_equal",
    f"""
WITH m AS (SELECT s.step, o_orderstatus, o_orderpriority, o_totalprice AS x, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * (1 + s.step) ELSE o_totalprice END AS y FROM orders, (VALUES (1e-9), (1e-3)) s(step)),
 x AS (SELECT step, o_orderstatus, o_orderpriority, x, row_number() OVER (PARTITION BY step, o_orderstatus, o_orderpriority ORDER BY x) AS rn FROM m),
 y AS (SELECT step, o_orderstatus, o_orderpriority, y, row_number() OVER (PARTITION BY step, o_orderstatus, o_orderpriority ORDER BY y) AS rn FROM m)
SELECT step, bool_and({LOOSE_PAIR}) AS equal FROM x JOIN y USING (step, o_orderstatus, o_orderpriority, rn) GROUP BY step
""",
)
def v2_tolerant_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (V.tolerant_equal(*moved_orders(spark, sf_dir, s)).select(F.lit(s).alias("step"), "equal") for s in (1e-9, 1e-3))
    return one.unionAll(two)


@query(
    "v2_nested_numbers",
    f"""
WITH l AS (SELECT s.step, l_orderkey, list_sort(list(l_extendedprice)) AS x, list_sort(list(CASE WHEN l_orderkey % 7 = 0 THEN l_extendedprice * (1 + s.step) ELSE l_extendedprice END)) AS y
           FROM lineitem, (VALUES (1e-9), (1e-3)) s(step) GROUP BY ALL)
SELECT step, bool_and(len(list_filter(list_zip(x, y), lambda p: NOT abs(p[1] - p[2]) <= greatest(1e-6 * greatest(abs(p[1]), abs(p[2])), 1e-9))) = 0) AS equal FROM l GROUP BY step
""",
)
def v2_nested_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's prices as one array cell, in another order and a little moved on one side."""
    lines = table(spark, sf_dir, "lineitem")

    def prices(step: float, down: bool) -> DataFrame:
        moved = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_extendedprice") * (1 + step)).otherwise(F.col("l_extendedprice"))
        return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(moved), asc=not down).alias("prices"))

    one, two = (V.tolerant_equal(prices(0.0, False), prices(s, True)).select(F.lit(s).alias("step"), "equal") for s in (1e-9, 1e-3))
    return one.unionAll(two)


ALL_NUMBERS = """
WITH m AS (SELECT s.step, l_extendedprice AS x, l_extendedprice * (1 + s.step) AS y, l_tax AS t FROM lineitem, (VALUES (1e-9), (3e-6)) s(step)),
 a AS (SELECT step, x, t, row_number() OVER (PARTITION BY step ORDER BY x, t) AS rn FROM m), b AS (SELECT step, y, t AS u, row_number() OVER (PARTITION BY step ORDER BY y, t) AS rn FROM m)
SELECT step, bool_and(abs(x - y) <= greatest(1e-6 * greatest(abs(x), abs(y)), 1e-9) AND abs(t - u) <= greatest(1e-6 * greatest(abs(t), abs(u)), 1e-9)) AS equal FROM a JOIN b USING (step, rn) GROUP BY step
"""


@query("v2_all_numbers", ALL_NUMBERS)
def v2_all_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No exact column at all: the pairs are numbered over sorted ranges."""
    a = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_tax")
    one, two = (V.tolerant_equal(a, a.select(F.col("l_extendedprice") * (1 + s), "l_tax")).select(F.lit(s).alias("step"), "equal") for s in (1e-9, 3e-6))
    return one.unionAll(two)


@query(
    "v3_ordered_pairs",
    """
WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, o_orderkey, o_totalprice AS x FROM orders),
 b AS (SELECT row_no, o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN x + 1 ELSE x * (1 + 1e-10) END AS y FROM a)
SELECT row_no, abs(x - y) <= greatest(1e-6 * greatest(abs(x), abs(y)), 1e-9) AS ok FROM a JOIN b USING (row_no)
""",
)
def v3_ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") * (1 + 1e-10)))
    return V.ordered_pairs(a, b)


@query(
    "v4_tolerant_match",
    f"""
WITH x AS (SELECT o_orderstatus, o_orderpriority, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS rn FROM orders WHERE o_orderpriority = '1-URGENT'),
 y AS (SELECT o_orderstatus, o_totalprice * (1 + 1e-7) AS y, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS rn FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderstatus, o_orderpriority, CAST(count(*) FILTER (NOT {LOOSE_PAIR}) AS BIGINT) AS unmatched_a, CAST(count(*) FILTER (NOT {LOOSE_PAIR}) AS BIGINT) AS unmatched_b FROM x JOIN y USING (o_orderstatus, rn) GROUP BY ALL
""",
)
def v4_tolerant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tolerant_match(*moved_orders(spark, sf_dir, 1e-7))


@query(
    "v4_two_numbers",
    """
WITH o AS (SELECT o_orderstatus, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS c, o_orderkey % 11 = 0 AS moved, o_orderkey % 13 = 5 AS gone FROM orders)
SELECT o_orderstatus, CAST(count(*) FILTER (WHERE moved OR gone) AS BIGINT) AS unmatched_a, CAST(count(*) FILTER (WHERE moved AND NOT gone) AS BIGINT) AS unmatched_b FROM o GROUP BY o_orderstatus
""",
)
def v4_two_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two numbers that are near in either order: prices and customers a little moved, some moved for good, some missing.
    Those moved for good go below all prices: a hundredth more would, in many orders, now and then be another order's price."""
    orders = table(spark, sf_dir, "orders")
    a = orders.select("o_orderstatus", "o_totalprice", F.col("o_custkey").cast("double").alias("c"))
    price = F.col("o_totalprice")
    price = F.when(F.col("o_orderkey") % 11 == 0, -1 - F.abs(price)).otherwise(price * F.when(F.col("o_orderkey") % 2 == 0, 1 + 3e-7).otherwise(1 - 3e-7))
    b = orders.filter("o_orderkey % 13 <> 5").select("o_orderstatus", price.alias("o_totalprice"), (F.col("o_custkey") * (1 + 2e-7)).alias("c"))
    return V.tolerant_match(a, b)


V5_SQL = f"""
WITH p AS (SELECT o_orderpriority AS k, sum(l_extendedprice * (1 - l_discount)) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
 q AS (SELECT o_orderpriority AS k, sum(r) * (1 + 1e-9) AS y FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
 m AS (SELECT coalesce(bool_and(coalesce({LOOSE_PAIR}, false)), true) AS equal, count(*) AS n FROM p FULL JOIN q USING (k))
SELECT equal, CASE WHEN n = 0 THEN 'No result' WHEN equal THEN 'ok' ELSE 'inconsistent_result' END AS reason FROM m
"""


@query("v5_verdict", V5_SQL)
def v5_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verdict(*revenue_two_ways(spark, sf_dir))


def pair_rows(lines: DataFrame) -> DataFrame:
    """Fifty result pairs; side b is moved a little for every fifth pair and for good for every seventh."""
    a = lines.select((F.col("l_orderkey") % 50).alias("pair_id"), F.lit("a").alias("side"), "l_returnflag", F.col("l_extendedprice").alias("v"))
    v = F.when(F.col("pair_id") % 7 == 0, F.col("v") + 1).when(F.col("pair_id") % 5 == 0, F.col("v") * (1 + 1e-10)).otherwise(F.col("v"))
    return a.unionAll(a.select("pair_id", F.lit("b"), "l_returnflag", v))


def _v6_sql(lines: str) -> str:
    """Both bags, sorted by value within pair and flag, paired by row number."""
    return f"""
SELECT pair_id, count(*) AS rows_a, count(*) AS rows_b, bool_and(x = y) AS exact_equal, bool_and({LOOSE_PAIR}) AS tolerant_equal,
       CASE WHEN bool_and({LOOSE_PAIR}) THEN 'ok' ELSE 'inconsistent_result' END AS reason
FROM (SELECT pair_id, l_returnflag, x, row_number() OVER (PARTITION BY pair_id, l_returnflag ORDER BY x) AS rn FROM (SELECT l_orderkey % 50 AS pair_id, l_returnflag, l_extendedprice AS x FROM {lines}))
JOIN (SELECT pair_id, l_returnflag, y, row_number() OVER (PARTITION BY pair_id, l_returnflag ORDER BY y) AS rn FROM (SELECT l_orderkey % 50 AS pair_id, l_returnflag,
        CASE WHEN (l_orderkey % 50) % 7 = 0 THEN l_extendedprice + 1 WHEN (l_orderkey % 50) % 5 = 0 THEN l_extendedprice * (1 + 1e-10) ELSE l_extendedprice END AS y FROM {lines})) USING (pair_id, l_returnflag, rn)
GROUP BY pair_id"""


V6_SQL = _v6_sql("lineitem")
RETURNED = "(SELECT * FROM lineitem WHERE l_returnflag = 'R')"


@query("v6_batch_verify", V6_SQL)
def v6_batch_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.batch_verify(pair_rows(table(spark, sf_dir, "lineitem")), ["l_returnflag"], ["v"])


@query(
    "v7_combined_verdict",
    f"""
WITH m AS ({V6_SQL}), s AS ({_v6_sql(RETURNED)})
SELECT pair_id, coalesce(m.tolerant_equal, false) AND coalesce(s.tolerant_equal, false) AS equal,
       concat_ws('; ', CASE WHEN m.reason IS NULL THEN 'not run' WHEN m.reason <> 'ok' THEN m.reason END, CASE WHEN s.reason IS NULL THEN 'not run' WHEN s.reason <> 'ok' THEN s.reason END) AS reason
FROM m FULL JOIN s USING (pair_id)
""",
)
def v7_combined_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    main, sample = (V.batch_verify(pair_rows(x), ["l_returnflag"], ["v"]) for x in (lines, lines.filter("l_returnflag = 'R'")))
    return V.combined_verdict(main, sample)


@query(
    "v8_fk_closed_sample",
    """
WITH o AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100),
 l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
 c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l))),
 s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)),
 n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s))
SELECT 'lineitem' AS tbl, count(*) AS n FROM l UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l)
UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'supplier', count(*) FROM s UNION ALL SELECT 'nation', count(*) FROM n
UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)
UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)
""",
)
def v8_fk_closed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database of the lines of the hundred dearest orders (the sample size is the feature)."""
    tables = {t: table(spark, sf_dir, t) for t in CATALOG}
    keys = tables["orders"].orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("l_orderkey"))
    sample = V.fk_closed_sample(tables, CATALOG, "lineitem", keys)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t, df in sample.items()]
    for x in out[1:]:
        out[0] = out[0].unionAll(x)
    return out[0]


@query(
    "v8_self_reference",
    """
WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 3 THEN c_custkey WHEN c_custkey > 1 THEN c_custkey // 2 END AS up, c_nationkey FROM customer),
 r AS (SELECT * FROM l WHERE id IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) UNION SELECT l.* FROM r JOIN l ON l.id = r.up)
SELECT 'people' AS tbl, id FROM r UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM r)
UNION ALL SELECT 'region', r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM r))
""",
)
def v8_self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who were brought by a customer (some by themselves): the chains above the fifty richest (the sample size is
    the feature), and what those refer to."""
    up = F.when(F.col("c_custkey") % 17 == 3, F.col("c_custkey")).when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2))
    tables = {"people": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), up.alias("up"), "c_nationkey"), "nation": table(spark, sf_dir, "nation"), "region": table(spark, sf_dir, "region")}
    fk = lambda col, to, ref: {"col": col, "ref_table": to, "ref_col": ref}
    catalog = {"people": {"foreign_key": [fk("up", "people", "id"), fk("c_nationkey", "nation", "n_nationkey")]}, "nation": CATALOG["nation"], "region": CATALOG["region"]}
    sample = V.fk_closed_sample(tables, catalog, "people", table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select(F.col("c_custkey").alias("id")))
    ids = {"people": "id", "nation": "n_nationkey", "region": "r_regionkey"}
    out = [df.select(F.lit(t).alias("tbl"), F.col(ids[t]).cast("long").alias("id")) for t, df in sample.items()]
    for x in out[1:]:
        out[0] = out[0].unionAll(x)
    return out[0]


def violating_catalog() -> dict:
    catalog = copy.deepcopy(CATALOG)
    catalog["lineitem"]["primary_key"] = ["l_orderkey", "l_linenumber"]
    return catalog


def _v9_sql() -> str:
    say = lambda t, rule, body: f"SELECT '{t}' AS tbl, '{rule}' AS rule, count(*) AS violations FROM ({body})"
    out = []
    for t, spec in violating_catalog().items():
        if pk := spec["primary_key"]:
            out.append(say(t, f"primary key {','.join(pk)}", f"SELECT 1 FROM {t} GROUP BY {', '.join(pk)} HAVING count(*) > 1"))
            out.append(say(t, f"primary key not null {','.join(pk)}", f"SELECT 1 FROM {t} WHERE {' OR '.join(f'{c} IS NULL' for c in pk)}"))
        for fk in spec["foreign_key"]:
            out.append(say(t, f"foreign key {fk['col']}", f"SELECT 1 FROM {t} WHERE {fk['col']} IS NOT NULL AND {fk['col']} NOT IN (SELECT {fk['ref_col']} FROM {fk['ref_table']})"))
        for c in spec["cols"]:
            name = c["col_name"]
            if "NOT NULL" in c["attribute"]:
                out.append(say(t, f"not null {name}", f"SELECT 1 FROM {t} WHERE {name} IS NULL"))
            if "UNIQUE" in c["attribute"]:
                out.append(say(t, f"unique {name}", f"SELECT 1 FROM {t} WHERE {name} IS NOT NULL GROUP BY {name} HAVING count(*) > 1"))
            if values := c["type"].get("values"):
                listed = ", ".join(f"'{v}'" for v in values)
                out.append(say(t, f"enum {name}", f"SELECT 1 FROM {t} WHERE {name} NOT IN ({listed})"))
    return " UNION ALL ".join(out)


@query("v9_check_constraints", _v9_sql())
def v9_check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_constraints({t: table(spark, sf_dir, t) for t in CATALOG}, violating_catalog())


@query("v10_nonempty_and_equal", f"SELECT * FROM ({V6_SQL}) WHERE rows_a > 0 AND tolerant_equal")
def v10_nonempty_and_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nonempty_and_equal(v6_batch_verify(spark, sf_dir))
