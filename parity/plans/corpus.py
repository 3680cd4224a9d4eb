"""Queries of the corpus operators; records, pairs, rules and catalogs are played by the given tables as the SQL of each view says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.functions import text as X
from parity.operators import catalog as C
from parity.operators import corpus as K
from parity.operators import retrieve as R

from .common import query, table

# Experiment records: an event is a record of a translator (event_type) in a direction (user_id % 8).
RESULTS = """(SELECT event_id AS record_id, event_type AS translator, CAST(user_id % 8 AS INTEGER) AS direction, CAST(json_extract(props, '$.k') AS INTEGER) % 11 + 1 AS points_n, value > 5 AS executable, value > 35 AS equal FROM events)"""
SHARES = "count(*) AS n, round(avg(CAST(executable AS INTEGER)), 6) AS acc_ex, round(avg(CAST(equal AS INTEGER)), 6) AS acc_res"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 11 + 1
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), F.col("event_type").alias("translator"), (F.col("user_id") % 8).cast("int").alias("direction"), k.alias("points_n"),
        (F.col("value") > 5).alias("executable"), (F.col("value") > 35).alias("equal"),
    )


# Query pairs: an order is a pair whose points are its parts' brands and whose tables are their types.
LINES = "(SELECT o_orderkey AS pair_id, o_custkey % 8 AS direction, p_brand AS point, p_type AS tbl FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"
POINTS = f"(SELECT pair_id, direction, point, count(*) AS num FROM {LINES} GROUP BY ALL)"
PAIRS = f"(SELECT pair_id, any_value(direction) AS direction, list(point) AS names, list(point || '=' || num ORDER BY point) AS listed, sum(num) AS total FROM {POINTS} GROUP BY pair_id)"
TABLES = f"(SELECT pair_id, list(DISTINCT tbl) AS tables FROM {LINES} GROUP BY pair_id)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    by_point = lines.groupBy("o_orderkey", "o_custkey", "p_brand").agg(F.count("*").alias("num"), F.collect_set("p_type").alias("t"))
    points = F.array_sort(F.collect_list(F.struct(F.col("p_brand").alias("point"), "num"))).alias("points")
    out = by_point.groupBy(F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 8).alias("direction")).agg(points, F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("tables"))
    return out


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a rule; its category is the type of its smallest part."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("point")).agg(F.min(F.struct("p_partkey", "p_type"))["p_type"].alias("category"))


RULES = "(SELECT p_brand AS point, arg_min(p_type, p_partkey) AS category FROM part GROUP BY p_brand)"


@query("s9_pending_work", "SELECT event_id FROM events WHERE event_id % 2 <> 0")
def s9_pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "events")
    return K.pending_work(work, work.filter("event_id % 2 = 0").select("event_id"), ["event_id"]).select("event_id")


@query("p7_pairs_within_points", f"SELECT pair_id FROM {PAIRS} WHERE len(list_filter(names, lambda x: x NOT LIKE '%1' AND x NOT LIKE '%2')) = 0")
def p7_pairs_within_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = [r["point"] for r in rules(spark, sf_dir).collect() if r["point"][-1] in "12"]
    return K.pairs_within_points(pairs(spark, sf_dir), brands).select("pair_id")


@query("p8_pairs_using_table", f"SELECT pair_id FROM {TABLES} WHERE list_contains(tables, (SELECT min(p_type) FROM part))")
def p8_pairs_using_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return K.pairs_using_table(pairs(spark, sf_dir), first).select("pair_id")


#: SQL text played from orders: every other one has a GROUP BY.
ORDER_SQL = "concat('SELECT o_orderkey FROM orders WHERE o_custkey = ', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN ' GROUP BY 1' ELSE '' END)"


@query("p9_pairs_matching_clauses", "SELECT 'where' AS need, o_orderkey FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT 'group', o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def p9_pairs_matching_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ORDER_SQL).alias("sql"))
    features = X.clause_features(F.col("sql"))
    one = K.pairs_matching_clauses(texts, features, ["has_where", "n_from"]).select(F.lit("where").alias("need"), "o_orderkey")
    return one.unionAll(K.pairs_matching_clauses(texts, features, ["has_where", "has_group_by"]).select(F.lit("group"), "o_orderkey"))


@query("p12_pairs_tables_agree", "SELECT o_orderkey FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 3)")
def p12_pairs_tables_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of six orders: two agree in another order, one each lacks a side, one lacks both and one differs."""
    k, ab, ba, c = F.col("o_orderkey") % 6, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"), F.lit("a")), F.array(F.lit("c"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k.isin(0, 1, 2, 5), ab).alias("src_tables"), F.when(k.isin(0, 1, 3), ba).when(k == 5, c).alias("tgt_tables"))
    return K.pairs_tables_agree(df).select("o_orderkey")


@query("p13_pairs_fulfilling", f"SELECT DISTINCT p.pair_id FROM {PAIRS} p JOIN {POINTS} q ON p.pair_id = q.pair_id WHERE q.point = (SELECT min(p_brand) FROM part) AND q.num = 1 AND p.total >= 4")
def p13_pairs_fulfilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return K.pairs_fulfilling(pairs(spark, sf_dir), [(first, 1)], 4).select("pair_id")


@query("j3_append_new", "SELECT 'part' AS origin, p_name AS name FROM part UNION ALL SELECT DISTINCT 'customer', c_mktsegment FROM customer WHERE c_mktsegment NOT IN (SELECT p_name FROM part)")
def j3_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select(F.lit("part").alias("origin"), F.col("p_name").alias("name"))
    extra = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_mktsegment").alias("name"))
    extra = extra.unionAll(base.select(F.lit("customer"), "name"))
    return K.append_new(base, extra, "name")


def catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two function catalogs from part names: keys even and odd."""
    part = table(spark, sf_dir, "part")
    entry = [F.col("p_partkey").alias("id"), F.concat(F.element_at(F.split("p_name", " "), -1), (F.col("p_partkey") % 301).cast("string"), F.lit("(x)")).alias("call"), F.col("p_name").alias("keyword"), F.concat_ws(" ", "p_type", "p_brand").alias("description")]
    return part.filter("p_partkey % 2 = 0").select(*entry), part.filter("p_partkey % 2 = 1").select(*entry)


@query("j4_unmatched_names", "SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND lower(split_part(p_name, ' ', -1)) || p_partkey % 301 NOT IN (SELECT lower(split_part(p_name, ' ', -1)) || p_partkey % 301 FROM part WHERE p_partkey % 2 = 1)")
def j4_unmatched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unmatched_names(*catalogs(spark, sf_dir), name="call").select("id")


@query(
    "j5_keyword_topk",
    """WITH a AS (SELECT p_partkey AS id, lower(trim(split_part(p_name, '(', 1))) AS a FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS id, lower(p_name) AS b, lower(p_type || ' ' || p_brand) AS d FROM part WHERE p_partkey % 2 = 1),
 n AS (SELECT DISTINCT a FROM a), m AS (SELECT DISTINCT b, d FROM b),
 s AS (SELECT a, b, d, CASE WHEN a = trim(split_part(b, '(', 1)) THEN 100 WHEN contains(b, a) OR contains(a, b) THEN 50 ELSE 0 END + CASE WHEN contains(d, a) THEN 20 ELSE 0 END AS score FROM n, m WHERE contains(b, a) OR contains(a, b) OR contains(d, a)),
 h AS (SELECT a, id AS tgt_id, score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS INTEGER) AS rank FROM s JOIN b USING (b, d))
SELECT a.id AS src_id, tgt_id, score, rank FROM h JOIN a USING (a) WHERE rank <= 5""",
)
def j5_keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_topk(*catalogs(spark, sf_dir), 5)


@query(
    "j6_cosine_topk",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), h AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.e, i.e) AS c FROM v q JOIN v i ON q.label = i.label WHERE q.vec_id % 100 = 0 AND i.vec_id <> q.vec_id)
SELECT query_id, item_id, greatest(0.0, least(100.0, round((1 - (1 - c) / 2) * 100, 2))) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS INTEGER) AS rank FROM h) WHERE rank <= 5""",
)
def j6_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return R.cosine_topk(v.filter("id % 100 = 0"), v, 5, "label")


@query(
    "j7_fk_neighbours",
    """WITH k AS (SELECT DISTINCT p_brand AS tbl, p_type AS ref_table FROM part UNION SELECT DISTINCT p_type, split_part(p_name, ' ', 1) FROM part),
 g AS (SELECT p_type AS tbl FROM part GROUP BY p_type HAVING min(p_size) = 1)
SELECT ref_table AS tbl FROM k WHERE tbl IN (SELECT tbl FROM g) UNION SELECT tbl FROM k WHERE ref_table IN (SELECT tbl FROM g)""",
)
def j7_fk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys read from the parts, brands to types and types to the first words of names: what is one key away from the types that have a part of size 1."""
    part = table(spark, sf_dir, "part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    keys = part.select(F.col("p_brand").alias("tbl"), F.col("p_type").alias("ref_table")).unionAll(part.select("p_type", first)).distinct()
    given = part.groupBy(F.col("p_type").alias("tbl")).agg(F.min("p_size").alias("s")).filter("s = 1")
    return C.fk_neighbours(keys, given)


@query(
    "j8_reserved_name_hits",
    """WITH c AS (SELECT source AS tbl, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: len(x) > 2))) AS col FROM documents),
 n AS (SELECT DISTINCT tbl, col FROM c), w AS (SELECT DISTINCT upper(lang) AS w FROM documents UNION SELECT DISTINCT upper(split_part(p_name, ' ', 1)) FROM part UNION SELECT 'THE' UNION SELECT 'LES')
SELECT tbl, col, coalesce((SELECT list_sort(list(DISTINCT lang)) FROM documents d WHERE d.source = n.tbl AND list_filter(regexp_split_to_array(d.text, '[^A-Za-z]+'), lambda x: len(x) > 2)[1] = n.col), []) AS links
FROM n WHERE upper(col) IN (SELECT w FROM w)""",
)
def j8_reserved_name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a source's documents are its columns; languages, the parts' first words and two frequent ones are reserved.  The first word
    of a document is a key of its source to its language."""
    docs, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    found = F.array_distinct(F.filter(F.split("text", "[^A-Za-z]+"), lambda x: F.length(x) > 2))
    columns = docs.select(F.col("source").alias("tbl"), F.explode(found).alias("col")).distinct()
    words = docs.select(F.col("lang").alias("word")).unionAll(part.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).unionAll(docs.select(F.explode(F.array(F.lit("the"), F.lit("les"))))).distinct()
    keys = docs.select(F.col("source").alias("tbl"), F.array(F.get(found, F.lit(0))).alias("cols"), F.col("lang").alias("ref_table"), F.array(F.lit("id")).alias("ref_cols")).distinct()
    return C.reserved_name_hits(columns, words, keys).filter("col is not null")


@query("j11_compatible_rules", "SELECT p_partkey AS rule_id FROM part WHERE NOT (p_size % 3 = 1)")
def j11_compatible_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules tagged by part size: one in three contradicts the queries' parameter, one in three has no tag."""
    k = F.col("p_size") % 3
    tag = F.when(k < 2, F.create_map(F.lit("pg"), F.create_map(F.lit("mode"), F.when(k == 0, "strict").otherwise("loose")))).otherwise(F.create_map(F.lit("pg"), F.create_map(F.lit("other"), F.lit("x"))))
    params = table(spark, sf_dir, "region").select(F.lit("pg").alias("dialect"), F.lit("mode").alias("param"), F.lit("strict").alias("value")).distinct()
    return C.compatible_rules(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), tag.alias("tag")), params).select("rule_id")


@query("g1_merge_point_counts", f"SELECT grp, string_agg(point || '=' || num, ',' ORDER BY point) AS points FROM (SELECT pair_id % 100 AS grp, point, CAST(sum(num) AS BIGINT) AS num FROM {POINTS} GROUP BY ALL) GROUP BY grp")
def g1_merge_point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = K.merge_point_counts(pairs(spark, sf_dir).withColumn("grp", F.col("pair_id") % 100), "grp")
    return merged.select("grp", F.array_join(F.transform("points", lambda p: F.concat(p["point"], F.lit("="), p["num"].cast("string"))), ",").alias("points"))


@query("g2_distinct_point_combos", f"SELECT CAST(direction AS VARCHAR) AS direction, count(DISTINCT listed) AS combos FROM {PAIRS} GROUP BY ROLLUP (direction)")
def g2_distinct_point_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.distinct_point_combos(pairs(spark, sf_dir)).withColumn("direction", F.col("direction").cast("string"))


CELL = "CASE WHEN {0} IS NULL THEN NULL WHEN regexp_full_match({0}, '-?[0-9]+') THEN 'INT' WHEN regexp_full_match({0}, '-?[0-9]+[.][0-9]+') THEN 'DOUBLE' WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*') THEN 'DATE' ELSE 'VARCHAR' END"
LINE_CELLS = ["CAST(l_orderkey AS VARCHAR)", "CAST(l_quantity AS VARCHAR)", "CAST(l_shipdate AS VARCHAR)", "l_returnflag"]


@query(
    "g3_type_histogram",
    f"""WITH c AS (SELECT unnest([{', '.join(CELL.format(c) for c in LINE_CELLS)}]) AS kind, unnest([1, 2, 3, 4]) AS col FROM lineitem), k AS (SELECT unnest({C.LISTED!r}) AS type_name)
SELECT type_name, count(kind) AS n FROM k LEFT JOIN c ON kind = type_name GROUP BY 1 UNION ALL SELECT 'columns', count(*) FROM c UNION ALL SELECT 'tables', count(DISTINCT col) FROM c""",
)
def g3_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of lineitem by the type that their text has."""
    cell = lambda c: F.when(c.rlike("^-?[0-9]+$"), "INT").when(c.rlike("^-?[0-9]+[.][0-9]+$"), "DOUBLE").when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "DATE").otherwise("VARCHAR")
    cells = [F.struct(cell(F.col(c).cast("string")).alias("type_name"), F.lit(str(i)).alias("tbl")) for i, c in enumerate(["l_orderkey", "l_quantity", "l_shipdate", "l_returnflag"])]
    columns = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*cells)).alias("c")).select("c.*").withColumn("col", F.col("type_name"))
    return C.type_histogram(columns)


@query("g4_accuracy_cube", f"SELECT translator, CAST(direction AS VARCHAR) AS direction, {SHARES} FROM {RESULTS} GROUP BY CUBE (translator, direction)")
def g4_accuracy_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.accuracy_cube(results(spark, sf_dir)).withColumn("direction", F.col("direction").cast("string"))


@query(
    "g5_accuracy_by_category",
    f"""SELECT translator, category, {SHARES} FROM (SELECT DISTINCT record_id, translator, executable, equal, category FROM {RESULTS} r JOIN lineitem ON l_orderkey = record_id JOIN part ON p_partkey = l_partkey JOIN {RULES} q ON q.point = p_brand) GROUP BY ALL""",
)
def g5_accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pairs(spark, sf_dir).select(F.col("pair_id").alias("record_id"), K.names_of(F.col("points")).alias("points"))
    return K.accuracy_by_category(results(spark, sf_dir).join(named, "record_id"), rules(spark, sf_dir))


@query("g6_accuracy_by_bucket", f"SELECT translator, CAST(CASE WHEN points_n >= 10 THEN 10 WHEN points_n >= 8 THEN 8 WHEN points_n >= 6 THEN 6 WHEN points_n >= 4 THEN 4 WHEN points_n >= 2 THEN 2 ELSE 1 END AS INTEGER) AS bucket, {SHARES} FROM {RESULTS} GROUP BY ALL")
def g6_accuracy_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.accuracy_by_bucket(results(spark, sf_dir), "points_n", [1, 2, 4, 6, 8, 10])


@query(
    "g7_accuracy_delta",
    f"""WITH a AS (SELECT translator, {SHARES} FROM {RESULTS} WHERE direction < 4 GROUP BY 1), b AS (SELECT translator, {SHARES} FROM {RESULTS} WHERE direction >= 4 GROUP BY 1)
SELECT translator, a.n AS n_a, a.acc_ex AS acc_ex_a, a.acc_res AS acc_res_a, b.n AS n_b, b.acc_ex AS acc_ex_b, b.acc_res AS acc_res_b, round(b.acc_res - a.acc_res, 6) AS delta FROM a FULL JOIN b USING (translator)""",
)
def g7_accuracy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return K.accuracy_delta(r.filter("direction < 4"), r.filter("direction >= 4"), ["translator"])


@query("g8_graded_score", f"SELECT translator, round(avg(CASE WHEN equal THEN 1.0 WHEN executable THEN 0.2 ELSE 0.0 END), 6) AS score FROM {RESULTS} GROUP BY 1")
def g8_graded_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.graded_score(results(spark, sf_dir), ["translator"])


@query("g10_coverage", f"SELECT p_brand AS point, p_brand IN (SELECT point FROM {POINTS}) AS covered FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT DISTINCT c_mktsegment, false FROM customer")
def g10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rules(spark, sf_dir).select("point").unionAll(table(spark, sf_dir, "customer").select("c_mktsegment"))
    return K.coverage(pairs(spark, sf_dir), marked)


@query(
    "g14_corpus_stats",
    f"""SELECT direction, count(*) AS n, round(avg(total), 6) AS total_avg, CAST(min(total) AS BIGINT) AS total_min, CAST(max(total) AS BIGINT) AS total_max, CAST(median(total) AS DOUBLE) AS total_mid, round(avg(nt), 6) AS n_tables_avg,
 CAST(min(nt) AS INTEGER) AS n_tables_min, CAST(max(nt) AS INTEGER) AS n_tables_max, CAST(median(nt) AS DOUBLE) AS n_tables_mid FROM (SELECT p.direction, p.total, len(t.tables) AS nt FROM {PAIRS} p JOIN {TABLES} t USING (pair_id)) GROUP BY direction""",
)
def g14_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("points", F.lit(0).cast("long"), lambda acc, p: acc + p["num"])
    return K.corpus_stats(pairs(spark, sf_dir).withColumn("total", total).withColumn("n_tables", F.size("tables")), ["direction"], ["total", "n_tables"])


@query("g15_verdict_breakdown", f"SELECT translator, CASE WHEN equal THEN 'ok' WHEN executable THEN 'inconsistent_result' ELSE 'error' END AS reason, count(*) AS n FROM {RESULTS} GROUP BY ALL")
def g15_verdict_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("equal"), "ok").when(F.col("executable"), "inconsistent_result").otherwise("error")
    return K.verdict_breakdown(results(spark, sf_dir), reason, ["translator"])


@query("g17_merge_params", "SELECT l_orderkey AS pair_id, 'pg' AS dialect, p_brand AS param, min(CAST(p_size % 4 AS VARCHAR)) AS value, min(CAST(p_size % 4 AS VARCHAR)) <> max(CAST(p_size % 4 AS VARCHAR)) AS conflict FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def g17_merge_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return C.merge_params(lines.select(F.col("l_orderkey").alias("pair_id"), F.lit("pg").alias("dialect"), F.col("p_brand").alias("param"), (F.col("p_size") % 4).cast("string").alias("value")))


@query("w4_quota_bounds", "SELECT o_orderpriority AS stratum, count(*) AS weight, CAST(round(sum(count(*)) OVER (ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) / sum(count(*)) OVER () * 150) AS BIGINT) AS upper FROM orders GROUP BY 1")
def w4_quota_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("weight"))
    return K.quota_bounds(weights, "stratum", "weight", 150)


@query("w5_last_good_attempt", "SELECT conv_id, coalesce(arg_max(md5(text), turn) FILTER (role = 'assistant'), 'Translation failed') AS answer FROM conversations GROUP BY conv_id")
def w5_last_good_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "conversations").withColumn("answer", F.md5("text"))
    return K.last_good_attempt(history, "conv_id", "turn", "answer", F.col("role") == "assistant")


@query("w6_dedupe_ranked", "SELECT l_orderkey, l_partkey, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL")
def w6_dedupe_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedupe_ranked(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("price")), "l_orderkey", "l_partkey", ["price"])


@query(
    "o3_rank_relevance",
    f"""WITH t AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS ts FROM part), b AS (SELECT min(p_brand) AS b FROM part)
SELECT p.pair_id, CAST(len(list_filter(p.names, lambda x: x <> b.b)) AS INTEGER) AS fresh, CAST(len(list_intersect(q.tables, t.ts[1:2])) AS INTEGER) AS used, CAST(len(list_intersect(q.tables, t.ts[3:4])) AS INTEGER) AS linked
FROM {PAIRS} p JOIN {TABLES} q USING (pair_id), t, b""",
)
def o3_rank_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_type").distinct().collect())
    brand = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return K.rank_relevance(pairs(spark, sf_dir), types[:2], types[2:4], [brand])


@query("o5_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 150")
def o5_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.seeded_sample(table(spark, sf_dir, "orders"), 150, 7, "o_orderkey").select("o_orderkey")


@query("o5_half_sample", "SELECT o_orderkey FROM orders ORDER BY md5('8|' || o_orderkey), o_orderkey LIMIT (SELECT count(*) // 2 FROM orders)")
def o5_half_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of half the rows: taken by a filter, with one bin of hashes sorted."""
    orders = table(spark, sf_dir, "orders")
    return K.seeded_sample(orders, orders.count() // 2, 8, "o_orderkey").select("o_orderkey")


@query("o5_seeded_split", "SELECT CASE WHEN substr(md5('7|' || o_orderkey), 1, 4) <= 'cccc' THEN 'train' ELSE 'dev' END AS part, count(*) AS n FROM orders GROUP BY 1")
def o5_seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.seeded_split(table(spark, sf_dir, "orders"), 0.8, 7, "o_orderkey").groupBy("part").agg(F.count("*").alias("n"))


O6_SQL = """
WITH RECURSIVE p AS (SELECT direction, point, row_number() OVER (PARTITION BY direction ORDER BY point) - 1 AS rank, count(*) OVER (PARTITION BY direction) AS size
                     FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS direction, p_brand AS point FROM part)),
 t AS (SELECT o_orderpriority AS stratum, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS low, count(*) AS weight FROM orders GROUP BY 1, 2),
 q AS (SELECT stratum, low, CAST(round(sum(weight) OVER (ORDER BY stratum ROWS UNBOUNDED PRECEDING) / sum(weight) OVER () * 600) AS BIGINT) AS upper FROM t),
 b AS (SELECT *, coalesce(lag(upper) OVER (ORDER BY stratum), 0) AS lower FROM q),
 s AS (SELECT range AS sample_id, stratum, low, CASE WHEN CAST('0x' || substr(md5('11|dir|' || range), 1, 8) AS BIGINT) / 4294967296.0 < 0.25 THEN 'a' ELSE 'b' END AS direction,
              low + CAST(floor(CAST('0x' || substr(md5('11|many|' || range), 1, 8) AS BIGINT) / 4294967296.0 * 2) AS INTEGER) AS many FROM range(600) JOIN b ON range >= lower AND range < upper),
 d AS (SELECT sample_id, stratum, direction, unnest(generate_series(1, many)) AS draw FROM s),
 g AS (SELECT d.*, p.point FROM d JOIN p ON p.direction = d.direction AND p.rank = CAST(floor(CAST('0x' || substr(md5('11|rule|' || sample_id || '|' || draw), 1, 8) AS BIGINT) / 4294967296.0 * p.size) AS INTEGER))
SELECT sample_id, direction, stratum, string_agg(point || '=' || num, ',' ORDER BY point) AS points FROM (SELECT sample_id, direction, stratum, point, count(*) AS num FROM g GROUP BY ALL) GROUP BY ALL
"""


@query("o6_draw_point_lists", O6_SQL)
def o6_draw_point_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    drawn = part.select(F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("direction"), F.col("p_brand").alias("point")).distinct()
    strata = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("weight")).select(F.col("o_orderpriority").alias("stratum"), F.substring("o_orderpriority", 1, 1).cast("int").alias("low"), (F.substring("o_orderpriority", 1, 1).cast("int") + 1).alias("high"), "weight")
    lists = K.draw_point_lists(drawn, 600, strata, [("a", 0.25), ("b", 0.75)], 11)
    return lists.withColumn("points", F.array_join(F.transform("points", lambda p: F.concat(p["point"], F.lit("="), p["num"].cast("string"))), ","))


def chained(names: list[str]) -> dict[str, list[str]]:
    """Each name linked with the next."""
    return {a: [b] for a, b in zip(names, names[1:], strict=False)}


U3_SQL = f"""
WITH RECURSIVE t AS (SELECT p_type AS a, lead(p_type) OVER (ORDER BY p_type) AS b FROM (SELECT DISTINCT p_type FROM part)),
 p AS (SELECT p.pair_id, p.names, q.tables FROM {PAIRS} p JOIN {TABLES} q USING (pair_id)),
 r AS (SELECT -1 AS step, CAST(NULL AS BIGINT) AS pair_id, 0 AS fresh, CAST([] AS VARCHAR[]) AS covered, CAST([] AS VARCHAR[]) AS used
       UNION ALL
       SELECT step + 1, top.pair_id, top.fresh, list_distinct(list_concat(covered, top.names)), list_distinct(list_concat(used, top.tables)) FROM (
         SELECT step, covered, used, arg_max({{'pair_id': x.pair_id, 'fresh': x.fresh, 'names': x.names, 'tables': x.tables}}, (x.fresh, x.in_use, x.linked, -x.pair_id)) AS top FROM (
           SELECT r.step, r.covered, r.used, p.pair_id, p.names, p.tables, len(list_filter(p.names, lambda n: NOT list_contains(r.covered, n))) AS fresh, len(list_intersect(p.tables, r.used)) AS in_use,
                  len(list_filter(p.tables, lambda n: NOT list_contains(r.used, n) AND list_contains(list_transform(list_filter(k.links, lambda l: list_contains(r.used, l.a)), lambda l: l.b), n))) AS linked
           FROM r, p, (SELECT list({{'a': a, 'b': b}}) AS links FROM t) k) x
         WHERE x.fresh > 0 GROUP BY ALL))
SELECT CAST(step AS INTEGER) AS step, pair_id, CAST(fresh AS BIGINT) AS fresh FROM r WHERE step >= 0
"""


@query("u3_greedy_cover", U3_SQL)
def u3_greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part types, a table of strata, stand for the linked tables."""
    types = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_type").distinct().collect())
    return K.greedy_cover(pairs(spark, sf_dir), rules(spark, sf_dir), chained(types))


@query("u4_points_in_common", f"SELECT pair_id, list(point ORDER BY point) AS points FROM {POINTS} WHERE point LIKE '%1' GROUP BY pair_id")
def u4_points_in_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.points_in_common(pairs(spark, sf_dir), rules(spark, sf_dir).filter("point like '%1'"))
