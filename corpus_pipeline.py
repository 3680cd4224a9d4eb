"""A training-corpus pipeline: five stages over ``documents``, each one operator of ``parity.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of docs; the last returns the
packed pieces.  Nulls: a null text is clean, short of words, without secrets and packs as its end token; a row without
doc_id is no copy of another and stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parity.llm import jaccard, packing, secrets, substrings, toxicity
from parity.llm.common import shared_folder, written
from parity.llm.queries import held_out, table
from parity.operators.numbering import numbered

TOXIC_CUT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the cut go.  The model is fitted on the labelled documents of the input tables."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return toxicity.score(rows, model, TOXIC_CUT).filter(F.col("score") < TOXIC_CUT).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link (five-word shingles, similarity 0.75), the one with the smallest doc_id stays.

    Rows are numbered by doc_id and text, so that rows of one doc_id with different texts are different documents; rows that share both are
    one document repeated, of which one row stays.  Texts without words link with nothing.  Columns may have any names.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text.alias("text"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))
    known, key = rows.filter("id is not null"), ["id", "x", "y"]
    numbers = written(numbered(known.select(*key).distinct(), *key, name="nth"), "numbers")
    classes = jaccard.jaccard_join(known.join(numbers, key).select(F.col("nth").alias("doc_id"), "text"))
    stay = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("nth")).distinct()
    kept = known.join(numbers.join(stay, "nth"), key).withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("row"))).filter("copy = 1")
    return kept.select("row.*").unionByName(rows.filter("id is null").select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that start elsewhere too go; a document without any keeps its text as it is."""
    both = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    done = substrings.remove_repeats(both)
    row = F.col("rest.row")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(row["text"])
    done = done.select(text.alias("text"), row.alias("row"))
    return done.select(*_with_text(docs, F.col("text"), F.col("row")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark."""
    done = secrets.redact(docs)
    return done.select(*_with_text(docs, F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 2048 tokens; ids: a piece's token ids, four bytes each, the lowest first."""
    packed = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def _with_text(docs: DataFrame, text: Column, row: Column | None = None) -> list[Column]:
    """docs' columns, from row if they are in a struct, with another text and its length."""
    kinds = dict(docs.dtypes)
    new = {"text": text, "n_chars": F.length(text).cast(kinds.get("n_chars", "long"))}
    return [(new[c] if c in new else row[c] if row is not None else F.col(f"`{c}`")).alias(c) for c in docs.columns]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # tokens and trained models are not expressible; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
