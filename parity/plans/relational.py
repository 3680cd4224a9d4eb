"""Queries of the projections, filters, joins, groupings, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.operators import catalog as C
from parity.operators import relational as R
from parity.operators.numbering import numbered

from .common import CATALOG, query, table


@query(
    "p1_align_columns",
    """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(NULL AS VARCHAR) AS p_brand, CAST(NULL AS VARCHAR) AS p_type, 'a' AS side FROM supplier
UNION ALL SELECT p_partkey, p_name, p_size, p_retailprice, p_brand, p_type, 'b' FROM part
""",
)
def p1_align_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = R.align_columns(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"), "pad")
    return a.withColumn("side", F.lit("a")).unionAll(b.withColumn("side", F.lit("b")))


@query("p2_drop_unsupported", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def p2_drop_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = {"orders": {**CATALOG["orders"], "cols": [{**c, "type": {"type_name": "INTERVAL YEAR TO MONTH"}} if c["col_name"] == "o_orderdate" else c for c in CATALOG["orders"]["cols"]]}}
    return C.drop_unsupported(table(spark, sf_dir, "orders"), declared, "orders", "mysql")


@query("p3_with_unique_column", 'SELECT c_custkey, c_name, c_acctbal, c_acctbal * 2 AS c_name_1, upper(c_mktsegment) AS select_1 FROM customer')
def p3_with_unique_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer")
    df = R.with_unique_column(base.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), ["c", "name"], F.col("c_acctbal") * 2)
    return R.with_unique_column(df, ["select"], F.upper("c_mktsegment"), reserved=["SELECT"]).drop("c_mktsegment")


LINE_DATES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _line_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))


@query(
    "p4_date_part_filter",
    f"""SELECT 'month' AS part, count(*) AS n FROM {LINE_DATES} WHERE month(l_shipdate) = month(o_orderdate)
UNION ALL SELECT 'year', count(*) FROM {LINE_DATES} WHERE year(l_shipdate) - year(o_orderdate) < 2
UNION ALL SELECT 'day', count(*) FROM {LINE_DATES} WHERE day(l_shipdate) - day(o_orderdate) < 5""",
)
def p4_date_part_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _line_dates(spark, sf_dir)
    out = None
    for part, op, n in (("month", "=", 0), ("year", "<", 2), ("day", "<", 5)):
        one = R.date_part_filter(df, "l_shipdate", "o_orderdate", part, op, n).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = out.unionAll(one) if out is not None else one
    return out


@query(
    "p5_modal_like_filter",
    """WITH m AS (SELECT split_part(p_type, ' ', 1) AS piece FROM (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1))
SELECT p_partkey, p_type FROM part, m WHERE contains(p_type, piece)""",
)
def p5_modal_like_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.modal_like_filter(table(spark, sf_dir, "part"), "p_type").select("p_partkey", "p_type")


@query(
    "p6_modal_month_filter",
    """WITH m AS (SELECT month(o_orderdate) AS m FROM (SELECT o_orderdate FROM orders GROUP BY o_orderdate ORDER BY count(*) DESC, o_orderdate LIMIT 1))
SELECT o_orderkey FROM orders, m WHERE month(o_orderdate) = m""",
)
def p6_modal_month_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.modal_month_filter(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey")


@query("p10_columns_of_family", "SELECT round(sum(p_retailprice), 2) AS p_retailprice_sum, round(CAST(sum(p_size) AS DOUBLE), 2) AS p_size_sum FROM part")
def p10_columns_of_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.agg(*(F.round(F.sum(F.col(c).cast("double")), 2).alias(f"{c}_sum") for c in C.columns_of_family(part, "number", CATALOG, "part")))


@query(
    "p11_predicate_mix",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority LIKE '%-%'
AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_totalprice > (SELECT avg(o_totalprice) / 2 FROM orders)""",
)
def p11_predicate_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    mean = orders.agg((F.avg("o_totalprice") / 2).alias("mean"))
    kept = orders.filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderpriority").like("%-%"))
    kept = kept.join(customers.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return kept.crossJoin(F.broadcast(mean)).filter("o_totalprice > mean").select("o_orderkey", "o_totalprice")


@query("j1_fk_join", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def j1_fk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fk_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), CATALOG, ("orders", "customer")).select("o_orderkey", "c_custkey", "c_mktsegment")


@query("j2_pk_self_join", "SELECT a.o_orderkey, a.o_totalprice, b.o_custkey AS o_custkey_2 FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey")
def j2_pk_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pk_self_join(table(spark, sf_dir, "orders"), CATALOG, "orders").select("o_orderkey", "o_totalprice", "o_custkey_2")


@query(
    "j9_other_joins",
    """SELECT 'left' AS form, count(*) AS n, count(o_orderkey) AS met FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000
UNION ALL SELECT 'cross', count(*), count(*) FROM nation, region WHERE n_regionkey <= r_regionkey
UNION ALL SELECT 'self', count(*), count(*) FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
)
def j9_other_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    say = lambda df, form, c: df.agg(F.count("*").alias("n"), F.count(c).alias("met")).select(F.lit(form).alias("form"), "n", "met")
    left = t("customer").join(t("orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 100000), "left")
    cross = t("nation").crossJoin(F.broadcast(t("region"))).filter("n_regionkey <= r_regionkey")  # two tables of fixed size
    both = t("supplier").alias("a").join(t("supplier").alias("b"), (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")))
    return say(left, "left", "o_orderkey").unionAll(say(cross, "cross", F.lit(1))).unionAll(say(both, "self", F.lit(1)))


@query(
    "j10_hierarchy_levels",
    """WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey // 10 > 0 THEN c_custkey // 10 END AS parent FROM customer),
 t AS (SELECT id, 0 AS level FROM l WHERE parent IS NULL UNION ALL SELECT l.id, t.level + 1 FROM t JOIN l ON l.parent = t.id)
SELECT id, level FROM t""",
)
def j10_hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.floor(F.col("c_custkey") / 10)
    links = table(spark, sf_dir, "customer").select("c_custkey", F.when(up > 0, up).alias("up"))
    return R.hierarchy_levels(links, "c_custkey", "up")


@query(
    "g9_modal_value",
    """SELECT grp, p AS modal FROM (SELECT o_custkey % 100 AS grp, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY count(*) DESC, o_orderpriority) AS rn
FROM orders GROUP BY 1, 2) WHERE rn = 1""",
)
def g9_modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.modal_value(table(spark, sf_dir, "orders").withColumn("grp", F.col("o_custkey") % 100), "o_orderpriority", ["grp"])


SUMS = "count(*) AS n, round(sum(l_quantity), 2) AS quantity"


def _sums() -> list:
    return [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")]


@query("g11_cube_sets", f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS gid, {SUMS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus))")
def g11_cube_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cube_sets(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], _sums())


@query("g12_grouping_sets", f"SELECT l_returnflag, l_linestatus, {SUMS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def g12_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grouping_sets(table(spark, sf_dir, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_linestatus"], []], _sums())


@query("g12_rollup", f"SELECT l_returnflag, l_linestatus, {SUMS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def g12_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(*_sums())


@query("g13_avg_of_expr", f"SELECT l_linenumber, round(avg(year(l_shipdate) - year(o_orderdate)), 6) AS avg_years FROM {LINE_DATES} GROUP BY 1")
def g13_avg_of_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.avg_of_expr(_line_dates(spark, sf_dir), R.date_part_diff(F.col("l_shipdate"), F.col("o_orderdate"), "year"), ["l_linenumber"], "avg_years")
    return out.withColumn("avg_years", F.round("avg_years", 6))


@query("g16_group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1 HAVING count(*) > 9")
def g16_group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = "o_totalprice"
    return R.group_having(table(spark, sf_dir, "orders"), ["o_custkey"], [F.count("*").alias("n"), F.round(F.sum(price), 2).alias("total"), F.min(price).alias("low"), F.max(price).alias("high")], "n > 9")


@query("w1_topk_per_key", "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn <= 3")
def w1_topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.topk_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rn")


@query("w2_categorical_window", "SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS dearest FROM part")
def w2_categorical_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.categorical_window(table(spark, sf_dir, "part"), CATALOG, "part", F.max("p_retailprice"), "dearest").select("p_partkey", "dearest")


@query("w3_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running FROM orders")
def w3_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.running_sum(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate"], "o_totalprice").select("o_orderkey", F.round("running", 2).alias("running"))


@query(
    "o1_order_by_dialect",
    """WITH d AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY s ASC NULLS FIRST, o_orderkey DESC NULLS LAST) - 1 AS mysql, row_number() OVER (ORDER BY s ASC NULLS LAST, o_orderkey DESC NULLS FIRST) - 1 AS pg,
       row_number() OVER (ORDER BY s DESC NULLS LAST, o_orderkey) - 1 AS stated FROM d""",
)
def o1_order_by_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    base = [("s", "asc"), ("o_orderkey", "desc")]
    ranked = lambda specs, d, name: numbered(df, *R.order_by_dialect(specs, d), name=name).select("o_orderkey", name)
    out = ranked(base, "mysql", "mysql").join(ranked(base, "pg", "pg"), "o_orderkey")
    return out.join(ranked([("s", "desc", "last"), ("o_orderkey", "asc")], "oracle", "stated"), "o_orderkey")


@query("o2_order_by_position", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC NULLS FIRST, c_custkey ASC NULLS LAST) - 1 AS place FROM customer")
def o2_order_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return numbered(df, *R.order_by_position(df, [(2, "desc"), (1, "asc")]), name="place").select("c_custkey", "place")


@query("o4_head_rows", "(SELECT 'nation' AS tbl, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 2) UNION ALL (SELECT 'part', p_name FROM part ORDER BY p_partkey LIMIT 2)")
def o4_head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.head_rows(table(spark, sf_dir, "nation"), 2, ["n_nationkey"]).select(F.lit("nation").alias("tbl"), F.col("n_name").alias("name"))
    return a.unionAll(R.head_rows(table(spark, sf_dir, "part"), 2, ["p_partkey"]).select(F.lit("part"), "p_name"))


@query("o7_limit_then_union", "(SELECT s_suppkey AS k, s_name AS name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5) UNION ALL SELECT c_custkey, c_name FROM customer")
def o7_limit_then_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), "s_acctbal")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(None).cast("double"))
    return R.limit_then_union(supplier, customer, [F.desc("s_acctbal"), "k"], 5).select("k", "name")


@query("u1_union_all_aligned", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def u1_union_all_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_all_aligned(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), "drop")


@query("u1_merge_queries", "SELECT n_nationkey, n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey")
def u1_merge_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_queries(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), CATALOG, ("nation", "region")).select("n_nationkey", "n_name", "r_name")


@query("u2_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u2_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_distinct(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select("s_nationkey"))
