"""Queries of the scalar functions, over columns built from the given tables; texts are built from known values, so that the SQL states the
value that parsing must give back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.functions import dates as D
from parity.functions import nested as N
from parity.functions import numbers as M
from parity.functions import text as X
from parity.functions.registry import register_all, satisfies
from parity.operators.relational import date_part_diff

from .common import query, table


def _t(spark: SparkSession, sf_dir: str, name: str, *cols) -> DataFrame:
    return table(spark, sf_dir, name).select(*cols)


#: SQL text played from customers.
SQL_TEXT = "concat('SELECT c_name, \\'it is ', c_mktsegment, '\\' FROM customer WHERE c_custkey = ', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' GROUP BY c_name HAVING count(*) > 1' ELSE ' ORDER BY 1' END)"


@query("x1_canon_key", r"SELECT count(*) AS n, count(DISTINCT lower(regexp_replace(text, '\s+', '', 'g'))) AS kinds FROM documents")
def x1_canon_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents", X.canon_key(F.col("text")).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("kinds"))


@query("x2_squash_space", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squashed FROM documents")
def x2_squash_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents", "doc_id", F.md5(X.squash_space(F.col("text"))).alias("squashed"))


@query("x3_quote_aware_split", "SELECT c_custkey, [c_name, '''' || c_mktsegment || ', x''', '\"a,b\"', CAST(c_nationkey AS VARCHAR)] AS pieces FROM customer")
def x3_quote_aware_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(c_name, ',\\'', c_mktsegment, ', x\\',,\"a,b\",', c_nationkey)")
    return _t(spark, sf_dir, "customer", "c_custkey", X.quote_aware_split(text).alias("pieces"))


@query("x4_call_arguments", "SELECT c_custkey, 'coalesce' AS fn, [c_name, 'g(' || c_nationkey || ', h(1))', '''x)' || c_mktsegment || ''''] AS args FROM customer")
def x4_call_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.expr("concat('coalesce(', c_name, ', g(', c_nationkey, ', h(1)), \\'x)', c_mktsegment, '\\')')")
    return _t(spark, sf_dir, "customer", "c_custkey", X.before_paren(call).alias("fn"), X.call_arguments(call).alias("args"))


@query("x5_freeze_now", "SELECT c_custkey, 'SELECT DATE ''2000-01-01'' - ' || c_custkey || ', TIMESTAMPTZ ''2000-01-01 16:30:21+0''' AS frozen FROM customer")
def x5_freeze_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.concat(F.lit("SELECT current_date - "), F.col("c_custkey"), F.lit(", NOW()"))
    return _t(spark, sf_dir, "customer", "c_custkey", X.freeze_now(sql, "pg").alias("frozen"))


@query("x6_token_count", "SELECT c_custkey, CAST(12 + CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 3 END AS INTEGER) AS tokens FROM customer")
def x6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer", "c_custkey", X.token_count(F.expr(SQL_TEXT)).alias("tokens"))


@query(
    "x7_clause_features",
    "SELECT c_custkey, true AS has_where, c_custkey % 2 = 0 AS has_group_by, c_custkey % 2 = 0 AS has_having, c_custkey % 2 <> 0 AS has_order_by, 1 AS n_select, 0 AS n_join, 1 AS n_from FROM customer",
)
def x7_clause_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer", "c_custkey", *(c.alias(k) for k, c in X.clause_features(F.expr(SQL_TEXT)).items()))


@query("x8_quote_ident", """SELECT p_partkey, '"' || p_type || '"' AS quoted, p_type AS bare, '`' || lower(p_type) || '`' AS again FROM part WHERE p_type LIKE '% %' UNION ALL SELECT p_partkey, p_type, p_type, lower(p_type) FROM part WHERE p_type NOT LIKE '% %'""")
def x8_quote_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = X.quote_ident(F.col("p_type"), "pg", ["SELECT", "ORDER"])
    return _t(spark, sf_dir, "part", "p_partkey", quoted.alias("quoted"), X.strip_ident(quoted).alias("bare"), X.requote_ident(quoted, "mysql").alias("again"))


@query("x10_fence_json", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer")
def x10_fence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('Here:\n```json\n{"name": "'), F.col("c_name"), F.when(F.col("c_custkey") % 3 > 0, F.lit('"}\n```')).otherwise(F.lit('"\n```')))
    return _t(spark, sf_dir, "customer", "c_custkey", X.fence_json(body, "name string")["name"].alias("name"))


@query("x12_unescape", "SELECT c_custkey, c_name || chr(10) || '\\' || c_mktsegment || chr(9) AS plain, '''' || c_name || '''''s''' AS q FROM customer")
def x12_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.concat("c_name", F.lit("\\n\\\\"), "c_mktsegment", F.lit("\\t"))
    q = F.concat(F.lit("q'!"), "c_name", F.lit("'s!'"))
    return _t(spark, sf_dir, "customer", "c_custkey", X.unescape(escaped).alias("plain"), X.qstring(q).alias("q"))


@query("x13_trim_set", "SELECT c_custkey, c_name AS both_sides, c_name || 'ab' AS leading FROM customer")
def x13_trim_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("abab"), "c_name", F.lit("ab"))
    return _t(spark, sf_dir, "customer", "c_custkey", X.trim_set(text, "ab").alias("both_sides"), X.trim_set(text, "ab", "leading").alias("leading"))


@query("x14_concat_dialect", "WITH d AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS a, o_orderpriority AS b FROM orders) SELECT o_orderkey, a || b AS pipes, concat(coalesce(a, ''), ' ', b) AS concat_form FROM d")
def x14_concat_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.nullif(F.col("o_orderstatus"), F.lit("P")), F.col("o_orderpriority")
    return _t(spark, sf_dir, "orders", "o_orderkey", X.concat_dialect(a, b, "pipes").alias("pipes"), X.concat_dialect(a, b, "concat").alias("concat_form"))


@query(
    "x15_render_literal",
    """SELECT o_orderkey, coalesce('''' || nullif(o_orderstatus, 'P') || '''', 'NULL') AS s, 'TO_TIMESTAMP(''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''', ''YYYY-MM-DD HH24:MI:SS'')' AS t,
CASE WHEN o_totalprice > 1000 THEN '1' ELSE '0' END AS b, CAST(o_custkey AS VARCHAR) AS n FROM orders""",
)
def x15_render_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = X.render_literal
    return _t(
        spark, sf_dir, "orders", "o_orderkey", lit(F.nullif(F.col("o_orderstatus"), F.lit("P")), "VARCHAR", "pg").alias("s"), lit(F.col("o_orderdate"), "TIMESTAMP", "oracle").alias("t"),
        lit(F.col("o_totalprice") > 1000, "BOOL", "oracle").alias("b"), lit(F.col("o_custkey"), "BIGINT", "pg").alias("n"),
    )


@query("d1_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y, %H:%M:%S') AS long_form, strftime(o_orderdate, '%d-%b-%y') AS short_form FROM orders")
def d1_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda f: F.date_format("o_orderdate", D.date_format_to_spark(f))
    return _t(spark, sf_dir, "orders", "o_orderkey", form("DD MONTH YYYY, HH24:MI:SS").alias("long_form"), form("DD-MON-RR").alias("short_form"))


@query("d2_parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS words, strftime(o_orderdate, '%Y-%m-%d') AS rr, strftime(o_orderdate, '%Y-%m-%d') AS dmy, CAST(NULL AS VARCHAR) AS bad FROM orders")
def d2_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    parse = lambda col, fmt: F.date_format(D.parse_date_multi(col, fmt), "yyyy-MM-dd")
    return _t(
        spark, sf_dir, "orders", "o_orderkey", parse(F.date_format(at, "MMM dd, yyyy"), "Mon DD, YYYY").alias("words"), parse(F.upper(F.date_format(at, "dd-MMM-yy")), "DD-MON-RR").alias("rr"),
        parse(F.date_format(at, "dd/MM/yyyy"), "DD/MM/YYYY").alias("dmy"), parse(F.col("o_orderpriority"), "DD/MM/YYYY").alias("bad"),
    )


@query(
    "d3_unit_interval",
    """SELECT p_partkey, CAST(p_size * 3 AS INTEGER) AS quarters, CAST(p_size AS BIGINT) * 604800000000 AS weeks, -(CAST(p_size AS BIGINT) * 86400000000 + 3600000000 * 2 + 60000000 * 3 + 4000000) AS day_second,
CAST(p_size * 12 + 5 AS INTEGER) AS year_month FROM part""",
)
def d3_unit_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    unit = D.parse_unit_interval
    return _t(
        spark, sf_dir, "part", "p_partkey", unit(size, "QUARTER")["months"].alias("quarters"), unit(size, "WEEK")["micros"].alias("weeks"),
        unit(F.concat(F.lit("-"), size, F.lit(" 2:03:04")), "DAY_SECOND")["micros"].alias("day_second"), unit(F.concat(size, F.lit("-5")), "YEAR TO MONTH")["months"].alias("year_month"),
    )


@query(
    "d4_interval_text",
    """SELECT p_partkey, CAST(-(p_size * 12 + 2) AS INTEGER) AS verbose_months, -(-3 * 86400 + 4 * 3600 + 5 * 60 + CAST(p_size AS BIGINT)) * 1000000 AS verbose_micros, CAST(p_size * 12 + 2 AS INTEGER) AS standard_months,
(3 * 86400 + 4 * 3600 + 5 * 60 + 6) * CAST(1000000 AS BIGINT) AS standard_micros, CAST(p_size * 12 + 2 AS INTEGER) AS iso_months, (3 * 86400 + 4 * 3600 + 5 * 60 + 6) * CAST(1000000 AS BIGINT) AS iso_micros FROM part""",
)
def d4_interval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    verbose = D.parse_interval_text(F.concat(F.lit("@ "), size, F.lit(" years 2 mons -3 days 4 hours 5 mins "), size, F.lit(" secs ago")))
    standard = D.parse_interval_text(F.concat(size, F.lit("-2 3 4:05:06")), "STANDARD")
    iso = D.parse_interval_text(F.concat(F.lit("P"), size, F.lit("Y2M3DT4H5M6S")), "ISO")
    named = {"verbose": verbose, "standard": standard, "iso": iso}
    return _t(spark, sf_dir, "part", "p_partkey", *(c[f].alias(f"{k}_{f}") for k, c in named.items() for f in ("months", "micros")))


@query("d5_shift_by", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 14 MONTH + INTERVAL 93784 SECOND, '%Y-%m-%d %H:%M:%S') AS moved FROM orders")
def d5_shift_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.struct(F.lit(14).alias("months"), F.lit(93_784_000_000).alias("micros"))
    return _t(spark, sf_dir, "orders", "o_orderkey", F.date_format(D.shift_by(F.col("o_orderdate"), by), "yyyy-MM-dd HH:mm:ss").alias("moved"))


@query("d6_date_part_diff", "SELECT CAST(year(l_shipdate) - year(o_orderdate) AS INTEGER) AS years, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS days, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def d6_date_part_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").join(_t(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [date_part_diff(F.col("l_shipdate"), F.col("o_orderdate"), p).alias(n) for p, n in (("year", "years"), ("days", "days"))]
    return lines.select(*parts).groupBy("years", "days").agg(F.count("*").alias("n"))


@query("d7_time_text", "SELECT p_partkey, -(CAST(p_partkey AS BIGINT) * 3600 + 2 * 60 + p_size % 60) AS seconds FROM part")
def d7_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("-%d:02:%02d", F.col("p_partkey"), F.col("p_size") % 60)
    return _t(spark, sf_dir, "part", "p_partkey", D.time_text_to_seconds(text).alias("seconds"))


@query("d8_combine_units", "SELECT p_partkey, CAST(-(p_size * 120 + 3) AS INTEGER) AS months, -(CAST(p_size AS BIGINT) * 1000 + 604800000000) AS micros FROM part")
def d8_combine_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array(*map(F.lit, ("decade", "quarter", "millisecond", "WEEK")))
    got = D.combine_units(units, F.array(F.col("p_size"), F.lit(1), F.col("p_size"), F.lit(1)), F.lit(-1))
    return _t(spark, sf_dir, "part", "p_partkey", got["months"].alias("months"), got["micros"].alias("micros"))


@query("m1_locale_number", "SELECT o_orderkey, round(o_totalprice, 2) AS point_form, round(o_totalprice, 2) AS comma_form, CAST(NULL AS DOUBLE) AS bad FROM orders")
def m1_locale_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_number("o_totalprice", 2)
    comma = F.translate(text, ",.", ".,")
    parse = M.parse_locale_number
    return _t(spark, sf_dir, "orders", "o_orderkey", parse(text).alias("point_form"), parse(comma, "comma").alias("comma_form"), parse(F.col("o_orderpriority")).alias("bad"))


@query("m2_number_text", "SELECT p_partkey, format('{:.3f}', p_size + 0.25) AS t FROM part")
def m2_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part", "p_partkey", M.number_text(F.col("p_size") + 0.25, 3).alias("t"))


@query(
    "m3_is_close",
    """WITH d AS (SELECT l_extendedprice AS x, CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice * (1 + 1e-7) WHEN 1 THEN l_extendedprice * (1 + 1e-5) ELSE 'NaN'::DOUBLE END AS y FROM lineitem)
SELECT NOT isnan(y) AND abs(x - y) <= greatest(1e-6 * greatest(abs(x), abs(y)), 1e-9) AS near, count(*) AS n FROM d GROUP BY 1""",
)
def m3_is_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = F.col("l_extendedprice"), F.col("l_linenumber") % 3
    y = F.when(k == 0, x * (1 + 1e-7)).when(k == 1, x * (1 + 1e-5)).otherwise(F.lit(float("nan")))
    return _t(spark, sf_dir, "lineitem", M.is_close(x, y).alias("near")).groupBy("near").agg(F.count("*").alias("n"))


@query("m4_decimals_to_double", "SELECT o_orderkey, round(o_totalprice, 2) AS price, [round(o_totalprice, 2)] AS listed FROM orders")
def m4_decimals_to_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(15,2)")
    return M.decimals_to_double(_t(spark, sf_dir, "orders", "o_orderkey", price.alias("price"), F.array(price).alias("listed")))


@query("n1_canon_nested", "SELECT c_custkey, list_sort([c_name, c_mktsegment]) AS arr, ['a', 'b'] AS ks, [CAST(c_nationkey AS BIGINT), c_custkey] AS vs FROM customer")
def n1_canon_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer", "c_custkey", F.array("c_name", "c_mktsegment").alias("arr"), F.create_map(F.lit("b"), F.col("c_custkey"), F.lit("a"), F.col("c_nationkey").cast("long")).alias("m"))
    return N.canon_rows(df).select("c_custkey", "arr", F.col("m.key").alias("ks"), F.col("m.value").alias("vs"))


@query("n2_array_text", "SELECT c_custkey, [c_name, c_mktsegment] AS arr, '[\"' || c_name || '\",\"' || c_mktsegment || '\"]' AS t FROM customer")
def n2_array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = N.array_to_text(F.array("c_name", "c_mktsegment"))
    return _t(spark, sf_dir, "customer", "c_custkey", N.array_from_text(text).alias("arr"), text.alias("t"))


@query("n3_points", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'POINT(' || CAST(c_nationkey AS DOUBLE) || ' ' || CAST(c_custkey % 90 AS DOUBLE) || ')' END AS pg, CASE WHEN c_custkey % 4 > 0 THEN 'POINT(' || CAST(c_custkey % 90 AS DOUBLE) || ' ' || CAST(c_nationkey AS DOUBLE) || ')' END AS mysql FROM customer")
def n3_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("c_nationkey").alias("longitude"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 90).alias("latitude")))
    point = N.point_from_json(body)
    return _t(spark, sf_dir, "customer", "c_custkey", N.point_text(point).alias("pg"), N.point_text(point, "mysql").alias("mysql"))


@query("n4_xml", "SELECT c_custkey, [c_name, c_mktsegment] AS names, 2 AS n FROM customer")
def n4_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit("<c><n>"), "c_name", F.lit("</n><n>"), "c_mktsegment", F.lit("</n></c>"))
    return _t(spark, sf_dir, "customer", "c_custkey", N.xml_values(xml, "/c/n/text()").alias("names"), N.xml_count(xml, "count(/c/n)").alias("n"))


@query("n5_item_fingerprint", """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS fingerprint FROM part""")
def n5_item_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.item_fingerprint(_t(spark, sf_dir, "part", "p_size", "p_partkey", "p_brand")).select("p_partkey", "fingerprint")


@query("f1_register_all", "SELECT c_custkey, ['x', CAST(c_custkey AS VARCHAR)] AS args, CAST(c_nationkey * 3 AS INTEGER) AS months, CAST(1234.5 AS DOUBLE) AS n FROM customer")
def f1_register_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_all(spark, "parity_")
    table(spark, sf_dir, "customer").createOrReplaceTempView("f1_customer")
    return spark.sql("SELECT c_custkey, parity_call_arguments(concat('f(x, ', c_custkey, ')')) AS args, parity_unit_interval(c_nationkey, 'QUARTER').months AS months, parity_locale_number('1,234.5') AS n FROM f1_customer")


@query("f2_satisfies", "SELECT count(*) AS rows_read, count(*) AS dates, CAST(0 AS BIGINT) AS intervals, CAST(0 AS BIGINT) AS escapes FROM orders")
def f2_satisfies(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _t(spark, sf_dir, "orders", F.date_format("o_orderdate", "dd-MMM-yy").alias("d"), "o_orderpriority")
    yes = lambda name, c, **how: F.count(F.when(satisfies(name, F.col(c), **how), 1))
    return texts.agg(F.count("*").alias("rows_read"), yes("date", "d", fmt="DD-MON-RR").alias("dates"), yes("interval", "o_orderpriority").alias("intervals"), yes("escape", "o_orderpriority").alias("escapes"))
