"""The prefix trie against plain Python: shared openings, long chains over many shards, nulls, ties, copies, empty tables, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parity.llm import trie
from parity.llm.queries import shared_openings
from parity.llm.sequences import ordered

SCHEMA = "conv_id long, turn long, role string, text string, p1 string, __part string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    ids, nodes = {}, {}
    for c, s in made.items():
        at = 0
        nodes.setdefault(0, (None, [], [], 0, 0))[1].append(c)
        for d, row in enumerate(s, 1):
            up, at = at, ids.setdefault((at, row), len(ids) + 1)
            nodes.setdefault(at, (up, [], [], len(row[1]), d))[1].append(c)
        nodes[at][2].append(c)
    kids = {n: 0 for n in nodes}
    leaves, saved = dict(kids), {n: (len(v[1]) - 1) * v[3] for n, v in nodes.items()}
    for up, *_ in nodes.values():
        if up is not None:
            kids[up] += 1
    for n in sorted(nodes, key=lambda n: -nodes[n][4]):
        leaves[n] += kids[n] == 0
        if nodes[n][0] is not None:
            leaves[nodes[n][0]] += leaves[n]
            saved[nodes[n][0]] += saved[n]
    sha = lambda ends: hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
    return {(min(v[1]), v[4], None if v[0] is None else min(nodes[v[0]][1]), len(v[1]), kids[n], leaves[n], saved[n], sha(v[2])) for n, v in nodes.items()}


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return {tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(*shared_openings(df)).select(*COLUMNS).collect()}


def rows_of(seed, convs, long):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), convs):
        n = rng.choice([1, 2, 3, 5, 9, long])
        copy = rng.random() < 0.5  # a stock conversation, cut somewhere
        for t in range(n):
            text = f"stock {t}" if copy and t < n - 1 else rng.choice(["a", "bb", "ccc é", "", None])
            rows.append((c, rng.choice([t, t, t, 3, None]) if not copy else t, rng.choice(["user", None]) if not copy else "user", text))
    return rows + rows[:7] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rows = rows_of(seed, 60, 150)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert made(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    assert made(spark, []) == set()
    assert made(spark, [(7, None, None, None)]) == plain_trie([(7, None, None, None)])
    turnless = [(c, 0, "user", "only") for c in range(1, 40)]  # those with h > 0 lose their turn and get none
    assert made(spark, turnless) == plain_trie(turnless)
    copies = [(c, t, "user", "x" * 10) for c in range(300, 330) for t in range(4)] + [(5, 0, "user", "x" * 200_000)]
    assert made(spark, copies) == plain_trie(copies)


def test_places_of_one_hot_conversation(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("c"), F.lit(1).alias("same"))
        rows = ordered(df, "c", [F.col("same")], []).groupBy("c").agg(F.min("at"), F.max("at"), F.count("*").alias("n"), F.countDistinct("at").alias("d")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r[1] == 0 and r[2] == r["n"] - 1 and r["d"] == r["n"] for r in rows) and len(rows) == 1335


def test_node_table_is_minimal_and_verified():
    rng = np.random.default_rng(3)
    k1, k2 = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 5000)
    k1[:100] = k1[0]  # equal in one half
    table = trie.NodeTable(k1, k2)
    assert sorted(table.slot) == list(range(5000))
    assert (table.find(k1, k2) == table.slot).all()
    assert (table.find(k2, k1) == -1).all() and (table.find(k1, k2 + 1) == -1).all()
    with pytest.raises(ValueError):
        trie.NodeTable(np.zeros(2, np.int64), np.zeros(2, np.int64))
