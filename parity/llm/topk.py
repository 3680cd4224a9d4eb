"""Exact inner-product top-k by MaxScore over sharded postings.

A vector is a document whose terms are its dimensions; the list of a dimension holds that component of every row of a shard.
Like rows share a block, and a block knows the least and the largest component of every dimension, so that each contribution
to a query is bounded.  Dimensions are split into essential and non-essential by those bounds, for a tile of queries at a time:
the essential lists of a block are added up for the whole tile as one matrix product, the others only for what can still be
among the k best.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256  # queries that share an order of dimensions
ROWS = 1024  # rows of a block
PIVOTS = 32  # rows around which a shard's rows are gathered
PROBE = 16  # non-essential lists added between two prunings
SPARSE = 64  # pairs are finished one by one where fewer than one in so many is left
LONG = 1 << 63


def _floor(scale: float):
    """floor of a scaled component as a double: the built-in floor gives a long, which large numbers (whole anyway) do not fit."""

    def of(c: Column) -> Column:
        y = c.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return of


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, weights): floor(scale * component), a whole number of any size held in a double; rows null, or with null or non-finite
    components, or whose scaled components are beyond a double, take no part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(scale)) < F.lit(float("inf"))))
    return vectors.filter(fine & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, _floor(scale)).alias("weights"),
    )


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every q, ties to the smaller id, and their places from 0, by q and place."""
    at = np.lexsort((ids, -score, q))
    q = q[at]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    at = at[keep]
    return q[keep], ids[at], score[at], place[keep]


def shard_topk(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best rows of one shard for every query, ties to the smaller id; query_ids are distinct."""
    n, d = x.shape
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    biggest = 2 * int(np.abs(x).max(initial=0)) * int(np.abs(queries).max(initial=0)) * d  # twice any score
    kind = np.float32 if biggest < 2**22 else np.float64 if biggest < 2**51 else np.int64  # floats are exact on whole numbers up to 2^24 and 2^53
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    if n > ROWS:  # like rows in one block, by id where they are equal; like queries in one tile
        pivots = x[:: -(-n // PIVOTS)].astype(np.float32)
        near = lambda v: np.argsort((v.astype(np.float32) @ pivots.T - (pivots**2).sum(1) / 2).argmax(1), kind="stable")
        rows, asked = near(x), near(queries)
        ids, x, query_ids, queries = ids[rows], x[rows], query_ids[asked], queries[asked]
    lists = np.ascontiguousarray(x.T, dtype=kind)
    starts = np.arange(0, n, ROWS)
    low, high = (np.array([f(x[b : b + ROWS], axis=0) for b in starts], dtype=kind).reshape(len(starts), d) for f in (np.min, np.max))
    for t in range(0, len(queries) if n else 0, TILE):
        names, w = query_ids[t : t + TILE], queries[t : t + TILE].astype(kind)
        order = np.argsort(-(np.abs(w).sum(0) * (high.max(0) - low.min(0))), kind="stable")
        w, postings = np.ascontiguousarray(w[:, order]), lists[order]
        tops = np.maximum(w, 0) @ high[:, order].T + np.minimum(w, 0) @ low[:, order].T
        by_name = np.argsort(names)
        floor = np.full(len(names), -biggest, kind)  # the k-th best so far, where there are k
        last_id = np.full(len(names), np.iinfo(np.int64).max)  # and its id
        best = found[0]
        for b in np.argsort(-tops.max(0), kind="stable"):
            at = np.flatnonzero(tops[:, b] >= floor)
            if not len(at):
                continue
            here = slice(starts[b], starts[b] + ROWS)
            v, mine, lo, hi = w[at], ids[here], low[b][order], high[b][order]
            most, least = np.maximum(v * lo, v * hi), np.minimum(v * lo, v * hi)
            rest = np.zeros((len(at), d + 1), kind)
            rest[:, :d] = most[:, ::-1].cumsum(1)[:, ::-1]
            worst = np.zeros_like(rest)
            worst[:, 1:] = least.cumsum(1)
            essential = (worst + rest < floor[at, None]).all(0)  # a row that is least in the lists so far cannot come in
            done = int(essential.argmax()) if essential.any() else d
            place = np.full(len(names), -1)
            place[at] = np.arange(len(at))
            who = by_name[np.minimum(np.searchsorted(names, mine, sorter=by_name), len(names) - 1)]
            own = np.flatnonzero((names[who] == mine) & (place[who] >= 0))  # a query's own rows are no candidates
            own = place[who[own]], own
            score = v[:, :done] @ postings[:done, here]
            while True:
                alive = score >= (floor[at] - rest[:, done])[:, None]
                alive[own] = False
                left = int(np.count_nonzero(alive))
                if done == d or left * SPARSE <= alive.size:
                    break
                to = min(done + PROBE, d)
                score += v[:, done:to] @ postings[done:to, here]
                done = to
            if left * SPARSE > alive.size and len(mine) >= k:  # the first blocks
                score[own] = -biggest - 1
                kth = np.partition(score, len(mine) - k, axis=1)[:, len(mine) - k]
                up = kth > floor[at]
                floor[at[up]], last_id[at[up]] = kth[up], np.iinfo(np.int64).max
                alive &= (score > floor[at, None]) | ((score == floor[at, None]) & (mine < last_id[at, None]))
            i, j = np.divmod(np.flatnonzero(alive), len(mine))
            if not len(i):
                continue
            full = score[i, j] + (v[i, done:] * postings[done:, here].T[j]).sum(1)
            best = _best(*(np.concatenate(c) for c in zip(best, (at[i], mine[j], full.astype(np.int64)), strict=True)), k)
            kth = tuple(c[best[3] == k - 1] for c in best[:3])
            floor[kth[0]], last_id[kth[0]] = kth[2], kth[1]
            best = best[:3]
        found.append((names[best[0]], best[1], best[2]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _ordered(score: int) -> bytes:
    """Bytes that sort as the whole numbers do, however large: length, then magnitude, both turned round for negative ones."""
    size = (abs(score).bit_length() + 7) // 8
    raw = (0x8000 + size).to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return raw if score >= 0 else bytes(255 - x for x in raw)


def cell_topk(ids: np.ndarray, rows: list[np.ndarray], query_ids: np.ndarray, queries: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best rows for every query.  Rows whose products could leave 64 bits, on either side, are scored
    in Python's whole numbers; the others by MaxScore."""
    width = max([0, *map(len, rows), *map(len, queries)])
    most = float(math.isqrt((1 << 61) // max(4 * width, 1)))
    fits = lambda vs: np.array([not len(v) or float(np.abs(v).max()) <= most for v in vs], dtype=bool)
    small, asked = fits(rows), fits(queries)
    pick = lambda vs, at: [vs[i] for i in np.flatnonzero(at)]
    out = shard_topk(ids[small], _matrix(pick(rows, small), width), query_ids[asked], _matrix(pick(queries, asked), width), k)
    if small.all() and asked.all():
        return out
    exact = lambda v: [int(x) for x in v]
    large = [(int(ids[i]), exact(rows[i])) for i in np.flatnonzero(~small)]
    best: dict[int, list[tuple[int, int]]] = {}
    for q, i, s in zip(*(c.tolist() for c in out), strict=True):
        best.setdefault(q, []).append((-s, i))
    every = None
    for q, w, fast in zip(query_ids.tolist(), queries, asked.tolist(), strict=True):
        if not fast and every is None:
            every = [(int(i), exact(v)) for i, v in zip(ids, rows, strict=True)]
        w = exact(w)
        more = [(-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, v in (large if fast else every) if i != q]
        best[q] = heapq.nsmallest(k, best.get(q, []) + more)
    merged = [(q, i, -s) for q, found in best.items() for s, i in found]
    return tuple(np.array(c, dtype=t) for c, t in zip(zip(*merged, strict=True), ("int64", "int64", object), strict=True)) if merged else out


def maxscore_topk(vectors: DataFrame, queries: DataFrame, k: int, chunk: int = 16384, block: int = 16384) -> DataFrame:
    """Each query's k best vectors by integer inner product: (query_id, rank, vec_id, score).

    vectors, queries: (vec_id long, weights array<double> of whole numbers).  Candidates are every row but those of the query's own id;
    shorter vectors count as padded with zeros.  A repeated candidate row counts each time, a repeated query id once
    (its smallest vector).  Fewer candidates than k: all of them.  Empty tables give an empty result.  Scores are exact and ranked as
    such at any size; one that a long cannot hold is shown as the nearest long.
    Work is cut in a grid of candidate chunks and query blocks of bounded size; only k rows per query and chunk
    leave a cell, and they are merged by rank.
    """
    queries = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("weights").alias("asked"))
    n, q = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // chunk)), max(1, -(-q // block))
    shards = max(shards, min(8, -(-n // 2048)))
    left = vectors.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "weights",
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "asked",
    )

    def cell(cands: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(cands) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "order": []})
        q, i, score = cell_topk(cands["vec_id"].to_numpy(), list(cands["weights"]), asked["query_id"].to_numpy(), list(asked["asked"]), k)
        order = None
        if score.dtype == object:  # scores at a long's limits are told apart by their bytes
            order = [None if -LONG < s < LONG - 1 else _ordered(s) for s in score]
            score = np.array([max(-LONG, min(s, LONG - 1)) for s in score], dtype=np.int64)
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": score, "order": order})

    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, "query_id long, vec_id long, score long, order binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("order"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
