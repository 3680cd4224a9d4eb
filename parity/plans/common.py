"""What the registered queries share: tables, the declared catalog, the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if there is one, the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _col(name: str, kind: str, attribute: tuple[str, ...] = (), semantic: str | None = None, **type_spec) -> dict:
    return {"col_name": name, "type": {"type_name": kind, **type_spec}, "attribute": list(attribute), "semantic": {"type": semantic} if semantic else {}}


def _fk(col: str, table_name: str, ref: str) -> dict:
    return {"col": col, "ref_table": table_name, "ref_col": ref}


CATALOG: dict[str, dict] = {
    "region": {"table": "region", "cols": [_col("r_regionkey", "INT", ("NOT NULL",), "NON_ARITHMETIC"), _col("r_name", "VARCHAR", length=25)], "primary_key": ["r_regionkey"], "foreign_key": [], "index": []},
    "nation": {"table": "nation", "cols": [_col("n_nationkey", "INT", ("NOT NULL",), "NON_ARITHMETIC"), _col("n_name", "VARCHAR", ("UNIQUE",), length=25), _col("n_regionkey", "INT", (), "NON_ARITHMETIC")],
               "primary_key": ["n_nationkey"], "foreign_key": [_fk("n_regionkey", "region", "r_regionkey")], "index": []},
    "customer": {"table": "customer", "cols": [_col("c_custkey", "BIGINT", ("NOT NULL",), "NON_ARITHMETIC"), _col("c_name", "VARCHAR", length=25), _col("c_nationkey", "INT", (), "NON_ARITHMETIC"), _col("c_acctbal", "DOUBLE"), _col("c_mktsegment", "VARCHAR", (), "CATEGORICAL", length=10)],
                 "primary_key": ["c_custkey"], "foreign_key": [_fk("c_nationkey", "nation", "n_nationkey")], "index": []},
    "supplier": {"table": "supplier", "cols": [_col("s_suppkey", "BIGINT", ("NOT NULL",), "NON_ARITHMETIC"), _col("s_name", "VARCHAR", length=25), _col("s_nationkey", "INT", (), "NON_ARITHMETIC"), _col("s_acctbal", "DOUBLE")],
                 "primary_key": ["s_suppkey"], "foreign_key": [_fk("s_nationkey", "nation", "n_nationkey")], "index": []},
    "part": {"table": "part", "cols": [_col("p_partkey", "BIGINT", ("NOT NULL",), "NON_ARITHMETIC"), _col("p_name", "VARCHAR", length=55), _col("p_brand", "VARCHAR", (), "CATEGORICAL", length=10), _col("p_type", "VARCHAR", (), "CATEGORICAL", length=25), _col("p_size", "INT"), _col("p_retailprice", "DOUBLE")],
             "primary_key": ["p_partkey"], "foreign_key": [], "index": []},
    "orders": {"table": "orders", "cols": [_col("o_orderkey", "BIGINT", ("NOT NULL",), "NON_ARITHMETIC"), _col("o_custkey", "BIGINT", (), "NON_ARITHMETIC"), _col("o_orderstatus", "ENUM", (), "CATEGORICAL", values=["F", "O", "P"]), _col("o_totalprice", "DOUBLE"), _col("o_orderdate", "TIMESTAMP"), _col("o_orderpriority", "VARCHAR", (), "CATEGORICAL", length=15)],
               "primary_key": ["o_orderkey"], "foreign_key": [_fk("o_custkey", "customer", "c_custkey")], "index": []},
    "lineitem": {"table": "lineitem", "cols": [_col("l_orderkey", "BIGINT", (), "NON_ARITHMETIC"), _col("l_partkey", "BIGINT", (), "NON_ARITHMETIC"), _col("l_suppkey", "BIGINT", (), "NON_ARITHMETIC"), _col("l_linenumber", "INT"), _col("l_quantity", "DOUBLE"), _col("l_extendedprice", "DOUBLE"), _col("l_discount", "DOUBLE"), _col("l_tax", "DOUBLE"), _col("l_returnflag", "ENUM", (), "CATEGORICAL", values=["A", "N", "R"]), _col("l_linestatus", "VARCHAR", (), "CATEGORICAL", length=1), _col("l_shipdate", "TIMESTAMP")],
                 "primary_key": [], "foreign_key": [_fk("l_orderkey", "orders", "o_orderkey"), _fk("l_partkey", "part", "p_partkey"), _fk("l_suppkey", "supplier", "s_suppkey")], "index": []},
}
