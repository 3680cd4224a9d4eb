"""Stages of the pipeline against plain Python, rows that share an id, columns named like helpers, names of any length before secrets."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from parity.llm import secrets, toxicity
from parity.llm.queries import held_out

random.seed(9)
VOCAB = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(500)]
some = lambda n: " ".join(random.choices(VOCAB, k=n))
BASE, PASSAGE = some(60), some(45)
ROWS = [
    (1, BASE), (1, some(50)), (1, BASE), (2, BASE + " more"), (3, BASE + " more or"), (4, None), (4, None), (5, ""), (None, BASE), (None, BASE), (6, "two words"), (7, "two words"), (7, some(40)),
    (8, some(20) + " " + PASSAGE + " " + some(20)), (9, PASSAGE + " " + some(90)), (9, "x"),
]
EXTRA = ["__key", "__nth", "__copy", "__text", "__toxicity", "row", "key", "gone", "nth", "copy", "x", "id", "score", "n_removed", "rest", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"keep {c}") for c in EXTRA} | {"n_chars": F.length("text")})


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text.lower() if text else "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_near(rows):
    """Different rows in order; every linked group keeps its first."""
    order = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], str(r[1])))
    group = list(range(len(order)))
    for _ in order:
        for i, a in enumerate(order):
            for j, b in enumerate(order):
                x, y = shingles(a[1]), shingles(b[1])
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    return sorted([r for i, r in enumerate(order) if group[i] == i] + [r for r in rows if r[0] is None], key=str)


def test_near_copies(spark, docs, sf_dir):
    got = P.drop_near_copies(spark, docs, sf_dir)
    want = plain_near(ROWS)
    assert kept(got) == want and got.columns == docs.columns
    assert sum(r[0] == 1 for r in want) == 2 and sum(r[0] == 4 for r in want) == 1 and sum(r[0] == 7 for r in want) == 1
    assert all(r[c] == f"keep {c}" for r in got.collect() for c in EXTRA)


def plain_cut(rows):
    starts = {}
    for n, (_, text) in enumerate(rows):
        w = words(text)
        for i in range(len(w) - 34):
            starts.setdefault(tuple(w[i : i + 35]), []).append((n, i))
    gone = {(n, i + j) for at in starts.values() if len(at) > 1 for n, i in at for j in range(35)}
    out = []
    for n, (doc, text) in enumerate(rows):
        w = words(text)
        left = [x for i, x in enumerate(w) if (n, i) not in gone]
        out.append((doc, " ".join(left) if len(left) < len(w) else text))
    return sorted(out, key=str)


def test_repeats(spark, docs, sf_dir):
    got = P.cut_repeats(spark, docs, sf_dir)
    assert kept(got) == plain_cut(ROWS) and got.columns == docs.columns
    assert all(r[c] == f"keep {c}" for r in got.collect() for c in EXTRA)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_toxic_documents_go(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(c) for c in EXTRA})
    got = P.drop_toxic(spark, table, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = toxicity.fit(table.select("doc_id", "text"), labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(table.select("doc_id", "text"), model).collect()}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, s in scores.items() if s < 0.3)
    assert got.columns == table.columns and 0 < got.count() < table.count()


FORMS = [("q" * 40 + "_token = \"{}\"", "Ab1!xyz9"), ("token_" + "r" * 30 + " = \"{}\"", "k9$Lm2#pQ"), ("token =      \"{}\"", "Zx8!cv7@b"), ("password" + " " * 50 + ":" + " " * 50 + "'{}'", "n5%Tg6^y"), ("key" * 50 + "={}", "aX9bY8cZ7dW6")]


def test_names_of_any_length(spark):
    rows = [(i, f"some words {form.format(value)} and words") for i, (form, value) in enumerate(FORMS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["value"].strip("\"'")) for r in secrets.candidates(df).collect()}
    assert found >= {(i, v) for i, (_, v) in enumerate(FORMS)}


def test_names_are_found_in_linear_time(spark):
    took = []
    for n in (20_000, 200_000):
        df = spark.createDataFrame([(0, "key" * n + " x "), (1, "token" + " " * n + "= "), (2, "secret_" * (n // 2) + "=")], "doc_id long, text string")
        began = time.time()
        secrets.candidates(df).count()
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 5


def test_redaction_keeps_all_else(spark):
    rows = [(i, f"words {VOCAB[i]} api_key = \"{''.join(random.choices('ABCdefGHI123456789+/', k=40))}\" end") for i in range(60)] + [(100, None), (101, "nothing here"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"keep {c}") for c in EXTRA})
    got = secrets.redact(df)
    assert got.columns == df.columns
    texts = {r["doc_id"]: r for r in got.collect()}
    assert all(r[c] == f"keep {c}" for r in texts.values() for c in EXTRA)
    assert all(texts[i]["text"] == re.sub('(?<=").*(?=")', "[SECRET]", t) for i, t in rows if i is not None and i < 60)
    assert texts[100]["text"] is None and texts[101]["text"] == "nothing here" and texts[None]["text"] == "no id"
