"""The declared catalog: column types, families, semantics and keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Catalog type names and their Spark types (parametrised ones are built below).
PLAIN = {
    "INT": T.IntegerType(), "BIGINT": T.LongType(), "BOOL": T.BooleanType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(),
    "DATE": T.DateType(), "TIME": T.DayTimeIntervalType(), "YEAR": T.ShortType(), "TIMESTAMP": T.TimestampNTZType(),
    "DATETIME": T.TimestampNTZType(), "TIMESTAMPTZ": T.TimestampType(), "INTERVAL YEAR TO MONTH": T.YearMonthIntervalType(),
    "VARCHAR": T.StringType(), "NVARCHAR": T.StringType(), "CHAR": T.StringType(), "TEXT": T.StringType(), "ENUM": T.StringType(),
    "UUID": T.StringType(), "JSON": T.StringType(), "JSONB": T.StringType(), "XML": T.StringType(), "BLOB": T.BinaryType(),
    "POINT": T.StructType([T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType())]),
}

#: The types that the histogram lists.
LISTED = [
    "INT", "BOOL", "DECIMAL", "DOUBLE", "DATE", "TIME", "YEAR", "TIMESTAMP", "DATETIME", "TIMESTAMPTZ", "INTERVAL YEAR TO MONTH", "VARCHAR",
    "NVARCHAR", "CHAR", "TEXT", "ENUM", "UUID", "JSON", "JSONB", "POINT", "XML", "BLOB", "ARRAY",
]

#: Types that have no name in a dialect.
UNSUPPORTED = {
    "mysql": {"INTERVAL YEAR TO MONTH"},
    "oracle": {"JSON", "JSONB"},
    "pg": set(),
    "snowflake": {"INTERVAL YEAR TO MONTH"},
    "sqlserver": {"INTERVAL YEAR TO MONTH"},
}


def spark_type(spec: Mapping) -> T.DataType:
    kind = spec["type_name"]
    if kind == "DECIMAL":
        return T.DecimalType(spec.get("precision") or 10, spec.get("scale") or 0)
    if kind == "ARRAY":
        return T.ArrayType(spark_type(spec["ele_type"]))
    return PLAIN[kind]


def catalog_to_struct(catalog: Mapping[str, dict], table: str, not_null: bool = True) -> T.StructType:
    """The table's declared schema; not_null=False leaves NOT NULL marks to check_constraints."""
    fields = [T.StructField(c["col_name"], spark_type(c["type"]), not (not_null and "NOT NULL" in c.get("attribute", []))) for c in catalog[table]["cols"]]
    return T.StructType(fields)


def family(kind: T.DataType) -> str | None:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return None


def columns_of_family(df: DataFrame, wanted: str, catalog: Mapping[str, dict] | None = None, table: str | None = None) -> list[str]:
    """Columns usable for a slot: of the family, or of the exact Spark type name, without NON_ARITHMETIC ones for numbers."""
    barred = set()
    if catalog and table and wanted == "number":
        barred = {c["col_name"] for c in catalog[table]["cols"] if c.get("semantic", {}).get("type") == "NON_ARITHMETIC"}
    return [f.name for f in df.schema if (family(f.dataType) == wanted or f.dataType.typeName() == wanted) and f.name not in barred]


def drop_unsupported(df: DataFrame, catalog: Mapping[str, dict], table: str, dialect: str) -> DataFrame:
    gone = {c["col_name"] for c in catalog[table]["cols"] if c["type"]["type_name"] in UNSUPPORTED[dialect]}
    return df.select(*(c for c in df.columns if c not in gone))


def columns_frame(spark: SparkSession, catalog: Mapping[str, dict]) -> DataFrame:
    rows = [(t, c["col_name"], c["type"]["type_name"], c.get("semantic", {}).get("type")) for t, spec in catalog.items() for c in spec["cols"]]
    return spark.createDataFrame(rows, "tbl string, col string, type_name string, semantic string")


def keys_frame(spark: SparkSession, catalog: Mapping[str, dict]) -> DataFrame:
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    rows = [(t, listed(k["col"]), k["ref_table"], listed(k["ref_col"])) for t, spec in catalog.items() for k in spec.get("foreign_key", [])]
    return spark.createDataFrame(rows, "tbl string, cols array<string>, ref_table string, ref_cols array<string>")


def fk_neighbours(keys: DataFrame, tables: Sequence[str] | DataFrame, outgoing_only: bool = False) -> DataFrame:
    """Tables one foreign-key hop away; outgoing_only leaves the given tables out.  tables: names, or a frame (tbl) of them."""
    if not isinstance(tables, DataFrame):
        tables = keys.sparkSession.createDataFrame([(t,) for t in tables], "tbl string")
    given = tables.select("tbl").distinct()
    out = keys.join(given, "tbl", "left_semi").select(F.col("ref_table").alias("tbl"))
    if outgoing_only:
        return out.join(given, "tbl", "left_anti").distinct()
    return out.unionAll(keys.join(given.toDF("ref_table"), "ref_table", "left_semi").select("tbl")).distinct()


def reserved_name_hits(columns: DataFrame, keywords: DataFrame, keys: DataFrame) -> DataFrame:
    """(tbl, col, links): tables (col null) and columns named like a reserved word, with the tables that keys link them to."""
    words = keywords.select(F.upper("word").alias("w")).distinct()
    named = columns.select("tbl", "col").unionAll(columns.select("tbl", F.lit(None).cast("string").alias("col")).distinct())
    hits = named.withColumn("w", F.upper(F.coalesce("col", "tbl"))).join(words, "w").drop("w")
    ends = keys.select("tbl", F.explode("cols").alias("kc"), F.col("ref_table").alias("other"))
    ends = ends.unionAll(keys.select(F.col("ref_table"), F.explode("ref_cols"), F.col("tbl")))
    linked = hits.join(ends, (hits["tbl"] == ends["tbl"]) & (hits["col"].isNull() | (hits["col"] == ends["kc"])), "left")
    return linked.groupBy(hits["tbl"], hits["col"]).agg(F.array_sort(F.collect_set("other")).alias("links"))


def type_histogram(columns: DataFrame) -> DataFrame:
    """(type_name, n) for every listed type, zeros included, then the totals of columns and tables."""
    spark = columns.sparkSession
    types = spark.createDataFrame([(t,) for t in LISTED], "type_name string")
    counted = columns.groupBy("type_name").agg(F.count("col").alias("n"))  # before the join: a type may have most of all columns
    per = types.join(counted, "type_name", "left").select("type_name", F.coalesce("n", F.lit(0)).alias("n"))
    totals = columns.agg(F.count("*").alias("c"), F.countDistinct("tbl").alias("t"))
    return per.unionAll(totals.select(F.lit("columns"), "c")).unionAll(totals.select(F.lit("tables"), "t"))


def compatible_rules(rules: DataFrame, params: DataFrame) -> DataFrame:
    """Rules (rule_id, tag map<dialect, map<param, value>>) without a tagged parameter that contradicts (dialect, param, value)."""
    tagged = rules.select("rule_id", F.explode("tag").alias("dialect", "m")).select("rule_id", "dialect", F.explode("m").alias("param", "value"))
    conflict = tagged.join(params.withColumnRenamed("value", "asked"), ["dialect", "param"]).filter("value <> asked").select("rule_id").distinct()
    return rules.join(conflict, "rule_id", "left_anti")


def merge_params(uses: DataFrame) -> DataFrame:
    """(pair_id, dialect, param, value, conflict) over the parameters of a pair's rules: two values for one parameter conflict."""
    return uses.groupBy("pair_id", "dialect", "param").agg(F.min("value").alias("value"), (F.min("value") != F.max("value")).alias("conflict"))
