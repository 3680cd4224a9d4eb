"""Sources and sinks on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.operators import catalog as C
from parity.operators import relational as R
from parity.operators import retrieve as Q
from parity.operators import statements
from parity.plans.common import CATALOG
from parity.sources import io as S

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("at", T.DateType())])


def test_delimited(spark, tmp_path):
    f = tmp_path / "x.tbl"
    f.write_bytes("1|Zo\xeb|2020-01-02\n2||\n\n3|a\n4|a|b|c\nx|a|2020-01-01\n".encode("latin-1"))
    good, bad = S.read_delimited(spark, str(f), SCHEMA)
    assert sorted((r["id"], r["name"], str(r["at"])) for r in good.collect()) == [(1, "Zoë", "2020-01-02"), (2, None, "None")]
    assert sorted(r["reason"] for r in bad.collect()) == ["2 fields, not 3", "4 fields, not 3", "unreadable value"]


def test_header_rows(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([["name", "id"], ["a", 1], [None, 2]]))
    (tmp_path / "empty.json").write_text(json.dumps([["name", "id"]]))
    got = S.read_header_rows_json(spark, str(tmp_path), SCHEMA).collect()
    assert sorted(((r["id"], r["name"], r["at"]) for r in got), key=str) == [(1, "a", None), (2, None, None)]


def test_pairs_keep_key_order(spark, tmp_path):
    rec = {"pg": "a", "mysql": "b", "points": [{"point": "p", "num": 2}], "tables": ["t"], "exp_res": {"x": {"tran_res": "c", "verify_res": {"execution": True, "error": ""}}}}
    (tmp_path / "p.json").write_text(json.dumps([rec], indent=2))
    r = S.read_query_pairs(spark, str(tmp_path)).collect()[0]
    assert (r["src_dialect"], r["tgt_dialect"], r["src_sql"], r["tgt_sql"]) == ("pg", "mysql", "a", "b")
    assert r["points"][0]["num"] == 2 and r["exp_res"]["x"]["verify_res"]["execution"]


def test_rules(spark, tmp_path):
    folder = tmp_path / "rules" / "literal"
    folder.mkdir(parents=True)
    (folder / "mysql_pg_point.json").write_text(json.dumps([{"Desc": "a", "SrcPattern": "s", "Tag": {"DB PARAMETER": {"pg": {"m": "x"}}}}, {"Desc": "b"}]))
    got = S.read_rule_catalog(spark, str(tmp_path / "rules")).collect()
    assert {(r["category"], r["direction"]) for r in got} == {("literal", "mysql_pg")}
    assert S.read_rule_catalog(spark, str(tmp_path / "rules"), tagged_only=True).count() == 1


def plain_statements(rows, head, max_len, max_rows):
    out, held, size = [], [], len(head)
    for row in rows:
        if held and (len(held) == max_rows or size + len(row) + 2 > max_len):
            out.append(head + ", ".join(held))
            held, size = [], len(head)
        held.append(row)
        size += len(row) + 2
    return out + ([head + ", ".join(held)] if held else [])


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_inserts_under_any_partitioning(spark, monkeypatch, block):
    monkeypatch.setattr(statements, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, "x" * rng.choice([0, 1, 5, 30, 200])) for i in range(300)]
    want = plain_statements([f"({i}, '{x}')" for i, x in rows], "INSERT INTO t (id, name) VALUES ", 150, 7)
    for parts in (1, 50):
        df = spark.createDataFrame(rows, "id int, name string").repartition(parts)
        got = S.render_inserts(df, "t", {"id": "INT", "name": "VARCHAR"}, "pg", max_len=150, max_rows=7, order=["id"]).collect()
        assert sorted(r["statement"] for r in got) == sorted(want) and sum(r["n_rows"] for r in got) == 300
    none = spark.createDataFrame([], "id int, name string")
    assert S.render_inserts(none, "t", {"id": "INT", "name": "VARCHAR"}, "pg").count() == 0


def test_dates_of_any_format(spark, tmp_path):
    day = lambda value, fmt: json.dumps({"value": value, "format": fmt})
    cells = [day("31.12.2021", "DD.MM.YYYY"), day("2021, 5 MAY", "YYYY, D MON"), day("05-may-21", "DD-MON-RR"), day("05-MAY-71", "dd-mon-rr"), day("20210505", "YYYYMMDD"), "2021-05-05", day("5", "nonsense'")]
    (tmp_path / "d.tbl").write_text("".join(f"{i}|{c}\n" for i, c in enumerate(cells)))
    schema = T.StructType.fromDDL("id int, d date")
    good, bad = S.read_delimited(spark, str(tmp_path / "d.tbl"), schema)
    assert {r["id"]: str(r["d"]) for r in good.collect()} == {0: "2021-12-31", 2: "2021-05-05", 3: "1971-05-05", 4: "2021-05-05", 5: "2021-05-05"}
    assert sorted(r["line"][0] for r in bad.collect()) == ["1", "6"]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    how = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    S.write_jdbc(df, url, "t", **how)
    back = S.read_query_jdbc(spark, url, "select * from t", **how)
    assert sorted((r[0], r[1]) for r in back.collect()) == [(1, "a"), (2, None)]
    rows = [(i if i < 900 else 5 if i < 950 else None,) for i in range(1000)]
    S.write_jdbc(spark.createDataFrame(rows, "n int"), url, "many", **how)
    read = lambda where, **more: S.read_query_jdbc(spark, url, f'select "n" from many where {where}', by='"n"', parts=4, **how, **more)
    got = read("1 = 1")
    assert sorted(str(r[0]) for r in got.collect()) == sorted(str(r[0]) for r in rows)
    sizes = [r["c"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    assert len(sizes) == 4 and max(sizes) < 400
    assert read('"n" = 5').count() == 51 and read('"n" > 5000').count() == 0
    S.write_jdbc(df.limit(0), url, "staged", **how)
    assert S.write_jdbc_staged(df, url, "staged", "one", **how) and not S.write_jdbc_staged(df, url, "staged", "one", **how)
    broken = df.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        S.write_jdbc_staged(broken, url, "staged", "two", **how)
    assert S.read_query_jdbc(spark, url, "select * from staged", **how).count() == 2
    assert S.write_jdbc_staged(df, url, "staged", "two", **how)
    assert S.read_query_jdbc(spark, url, "select * from staged", **how).count() == 4


def plain_topk(src, tgt, k):
    out = []
    for i, word, _ in src:
        name = word.lower().split("(")[0].strip() if word is not None else None
        hits = []
        for j, other, text in tgt:
            if name is None or other is None:
                continue
            low, said = other.lower(), (text or "").lower()
            score = (100 if name == low.split("(")[0].strip() else 50 if name in low or low in name else 0) + 20 * (name in said)
            if score:
                hits.append((-score, j))
        out += [(i, j, -s, n + 1) for n, (s, j) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def test_keywords_by_rarest_piece(spark):
    """All names share three letters, some have two, one or none."""
    rng = random.Random(1)
    word = lambda: "abc" + "".join(rng.choices("abcd", k=rng.randrange(4)))
    src = [(i, w, "") for i, w in enumerate([word() for _ in range(25)] + ["ab", "d", "", None, "ABC(x)", "zz"])]
    tgt = [(i, w, rng.choice([None, "", f"see {word()} and dd", "d"])) for i, w in enumerate([word() + "(a, b)" for _ in range(25)] + ["a", "cd", "", None, "zz(1)"])]
    f = lambda rows: spark.createDataFrame(rows, "id int, keyword string, description string")
    got = Q.keyword_topk(f(src), f(tgt), 4)
    assert sorted((r["src_id"], r["tgt_id"], r["score"], r["rank"]) for r in got.collect()) == plain_topk(src, tgt, 4)


def test_catalog(spark):
    schema = C.catalog_to_struct({"t": {"cols": [{"col_name": "d", "type": {"type_name": "DECIMAL", "precision": 12, "scale": 3}}, {"col_name": "a", "type": {"type_name": "ARRAY", "ele_type": {"type_name": "INT"}}}]}}, "t")
    assert schema.simpleString() == "struct<d:decimal(12,3),a:array<int>>"
    hist = {r["type_name"]: r["n"] for r in C.type_histogram(C.columns_frame(spark, CATALOG)).collect()}
    assert hist["tables"] == 7 and hist["columns"] == sum(len(t["cols"]) for t in CATALOG.values()) and hist["UUID"] == 0
    near = {r["tbl"] for r in C.fk_neighbours(C.keys_frame(spark, CATALOG), ["orders"], outgoing_only=True).collect()}
    assert near == {"customer"}


def test_type_histogram_counts_before_it_joins(spark):
    """No row of the columns enters the join with the listed types, however many have one type; unlisted types and null columns add nothing."""
    columns = spark.range(1000).select(F.when(F.col("id") < 900, "INT").when(F.col("id") < 990, "TEXT").when(F.col("id") < 995, "ODD").alias("type_name"), (F.col("id") % 3).cast("string").alias("tbl"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("col"))
    df = C.type_histogram(columns)
    hist = {r["type_name"]: r["n"] for r in df.collect()}
    assert {k: n for k, n in hist.items() if n} == {"INT": 810, "TEXT": 81, "columns": 1000, "tables": 3} and len(hist) == len(C.LISTED) + 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [type_name")


def test_null_order_by_dialect(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    run = lambda way, d: [r["x"] for r in df.orderBy(*R.order_by_dialect([("x", way)], d)).collect()]
    assert run("asc", "mysql") == [None, 1, 2] and run("desc", "mysql") == [2, 1, None]
    assert run("asc", "pg") == [1, 2, None] and run("desc", "oracle") == [None, 2, 1]


def test_unique_names():
    assert R.unique_name(["a"], ["b"]) == "b"
    assert R.unique_name(["total_price"], ["total", "price"]) == "total_price_1"
    assert len(R.unique_name(["x" * 20], ["x" * 30])) <= 20
