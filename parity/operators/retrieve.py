"""Matching of function catalogs by name, keyword score and cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parity.functions.text import before_paren

BLOCK, CHUNK = 1024, 16384  # queries and items of one matrix product


def unmatched_names(src: DataFrame, tgt: DataFrame, name: str = "keyword") -> DataFrame:
    """Source entries with no target of equal name before the parenthesis, whatever the case."""
    key = F.lower(F.trim(F.substring_index(name, "(", 1)))
    known = tgt.select(key.alias("__key")).distinct()
    return src.withColumn("__key", key).join(known, "__key", "left_anti").drop("__key")


GRAM = 3  # characters of the pieces by which names and descriptions meet


def _pieces(col: Column, n: int) -> Column:
    """The different pieces of n characters of a text; none, if it is shorter."""
    return F.when(F.length(col) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - (n - 1)), lambda i: F.substring(col, i, n)))).otherwise(F.array().cast("array<string>"))


def contained(small: DataFrame, big: DataFrame) -> DataFrame:
    """(s, t) where the text s of small (s) is inside t of big (t); both different texts, without nulls.

    A text of three characters or more is looked for under the rarest of its pieces, by how many texts of big hold it, and then verified; so a
    piece that all names share is no key of the join.  Shorter ones are pieces themselves, so that the join is the whole test.
    The empty text is in every text.
    """
    held = big.select("t", F.explode(_pieces(F.col("t"), GRAM)).alias("piece"))
    often = held.groupBy("piece").agg(F.count("*").alias("n"))
    own = small.filter(F.length("s") >= GRAM).select("s", F.explode(_pieces(F.col("s"), GRAM)).alias("piece")).join(often, "piece")
    keyed = own.groupBy("s").agg(F.min(F.struct("n", "piece")).alias("k")).select("s", F.col("k.piece").alias("piece"))
    out = keyed.join(held, "piece").filter(F.contains("t", "s")).select("s", "t")
    for n in range(1, GRAM):
        short = big.select("t", F.explode(_pieces(F.col("t"), n)).alias("s"))
        out = out.unionByName(small.filter(F.length("s") == n).join(short, "s").select("s", "t"))
    empty = small.filter("s = ''").limit(1)  # the different texts hold it once at most
    return out.unionByName(big.crossJoin(F.broadcast(empty)).select("s", "t"))


def keyword_topk(src: DataFrame, tgt: DataFrame, k: int) -> DataFrame:
    """(src_id, tgt_id, score, rank): the k best targets of a source entry by name.

    src, tgt: (id, keyword, description).  A name counts up to its parenthesis: equal ones score 100, the source's name inside the target's
    whole keyword, or that inside it, 50, the source's name in the target's description 20 more; only positive scores
    count, ties by id; null names match nothing.

    Equal names and descriptions repeat, so different ones are matched (see ``contained``) and the hits joined with their entries.
    """
    a = src.select(F.col("id").alias("src_id"), F.lower(before_paren(F.col("keyword"))).alias("a")).filter("a is not null")
    b = tgt.select(F.col("id").alias("tgt_id"), F.lower("keyword").alias("b"), F.coalesce(F.lower("description"), F.lit("")).alias("d")).filter("b is not null")
    names, texts = a.select("a").distinct(), b.select(F.col("b").alias("t")).unionAll(b.select("d")).distinct()
    inside = contained(names.toDF("s"), texts).withColumnRenamed("s", "a")
    words = b.select(F.col("b").alias("s")).distinct()
    around = contained(words, names.toDF("t")).select(F.col("t").alias("a"), F.col("s").alias("t"))  # and the other way round
    by_name = inside.unionByName(around).distinct()
    pairs = by_name.join(b.select("b", "d").distinct(), F.col("t") == F.col("b")).select("a", "b", "d")
    pairs = pairs.unionByName(inside.join(b.select("b", "d").distinct(), F.col("t") == F.col("d")).select("a", "b", "d")).distinct()
    met = F.contains("b", "a") | F.contains("a", "b")
    score = F.when(F.col("a") == F.lower(before_paren(F.col("b"))), 100).when(met, 50).otherwise(0) + F.when(F.contains("d", "a"), 20).otherwise(0)
    best = Window.partitionBy("a").orderBy(F.desc("score"), "tgt_id")
    hits = pairs.withColumn("score", score).join(b, ["b", "d"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return hits.join(a, "a").select("src_id", "tgt_id", "score", "rank")


CELL, MOST_CELLS, PROBES = 2048, 256, 512  # items of a cell on average; pivots, and items that queries are tried against first, at most
SLACK = 1e-6  # of an angle, for rounding


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_list()).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _cells(rows: pd.DataFrame, pivots: dict[int, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each row the nearest pivot of its length (-1: there is none), and the angles to all of them."""
    cell, angles = np.full(len(rows), -1), [np.zeros(0)] * len(rows)
    sizes = rows["vector"].map(len).to_numpy()
    for size in np.unique(sizes):
        if (at := np.flatnonzero(sizes == size)).size and size in pivots:
            a = np.arccos(np.clip(_unit(rows["vector"].iloc[at]) @ pivots[size].T, -1, 1))
            cell[at] = a.argmin(axis=1)
            for i, row in zip(at, a, strict=True):
                angles[i] = row
    return cell, angles


class _Grid:
    """The items in cells around pivots, and which cells each query must visit."""

    def __init__(self, queries: DataFrame, items: DataFrame, k: int, partition_col: str | None) -> None:
        fine = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        kind = [F.size("vector").cast("string"), *([F.coalesce(F.col(partition_col).cast("string"), F.lit("null"))] if partition_col else [])]
        plain = lambda df: df.filter(fine).select(F.concat_ws("|", *kind).alias("p"), "id", F.col("vector").cast("array<double>").alias("vector"))
        self.queries, self.items = plain(queries), plain(items)
        n = self.items.count()
        self.blocks = max(1, -(-self.queries.count() // BLOCK))
        probes = self.items.orderBy(F.xxhash64("id"), "id").limit(PROBES).toPandas()
        chosen = probes.head(min(MOST_CELLS, max(1, n // CELL)))
        pivots = {size: _unit(g) for size, g in chosen["vector"].groupby(chosen["vector"].map(len))} if len(chosen) else {}
        tried = {p: (g["id"].to_numpy(), _unit(g["vector"])) for p, g in probes.groupby("p")} if len(probes) else {}
        kinds = {"q": dict(self.queries.dtypes)["id"], "i": dict(self.items.dtypes)["id"]}

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    cell, angles = _cells(b, pivots)
                    yield b.assign(cell=cell, angle=[a[c] if c >= 0 else 0.0 for c, a in zip(cell, angles, strict=True)])

        def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A query, how far its k-th best can be, and its angles to the pivots."""
            for b in batches:
                if not len(b):
                    continue
                _, angles = _cells(b, pivots)
                far = np.full(len(b), np.pi)
                for i, (p, query, vector) in enumerate(zip(b["p"], b["id"], b["vector"], strict=True)):
                    if p in tried:
                        ids, units = tried[p]
                        near = np.sort(units[ids != query] @ _unit(pd.Series([vector]))[0])[::-1]
                        if len(near) >= k:
                            far[i] = np.arccos(np.clip(near[k - 1], -1, 1)) + SLACK
                yield b.assign(far=far, angles=[a.tolist() for a in angles])

        self.placed = self.items.mapInPandas(placed, f"p string, id {kinds['i']}, vector array<double>, cell int, angle double")
        asked = self.queries.mapInPandas(wanted, f"p string, id {kinds['q']}, vector array<double>, far double, angles array<double>")
        self.stats = self.placed.groupBy("p", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
        angle = F.coalesce(F.get("angles", F.col("cell")), F.lit(0.0))
        least = F.when(F.col("cell") < 0, 0.0).otherwise(F.greatest(F.lit(0.0), angle - F.col("high"), F.col("low") - angle))
        self.pairs = asked.join(self.stats, "p").withColumn("visit", least <= F.col("far") + SLACK)


def cosine_cells(queries: DataFrame, items: DataFrame, k: int, partition_col: str | None = None) -> DataFrame:
    """(query_id, cells, visited): how many cells hold items of a query's kind, and how many of them cosine_topk looks into."""
    return _Grid(queries, items, k, partition_col).pairs.groupBy(F.col("id").alias("query_id")).agg(F.count("*").alias("cells"), F.count_if("visit").alias("visited"))


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, partition_col: str | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the k nearest items by cosine, within the query's partition if one is named.

    queries, items: (id, vector[, partition_col]); ids are of any type that sorts.  score = round((1 - d / 2) * 100, 2) clipped to 0..100 for the distance d = 1 - cosine.
    A query's own id is no item.  Rows whose vector is null, empty or holds null or non-finite numbers take no part, nor do items of another length
    than the query.

    Exact, but not every item is looked at: items lie in cells around pivots (at most 256 of a sample by a hash of the id), of which the least and greatest
    angle to the pivot are known.  A query is first tried against at most 512 items; the k-th best of them bounds how far its answers can be,
    and by the triangle inequality of angles a cell that lies beyond is skipped (``cosine_cells`` tells how many).  What is left meets
    in bounded blocks; each keeps its k best, so little is shuffled for the merge.
    """
    grid = _Grid(queries, items, k, partition_col)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("int")
    left = grid.placed.join(F.broadcast(grid.stats.select("p", "cell", "n")), ["p", "cell"]).select("p", "cell", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(grid.blocks - 1))).alias("b"), "id", "vector")
    right = grid.pairs.filter("visit").select("p", "cell", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"), F.pmod(F.xxhash64("id"), F.lit(grid.blocks)).cast("int").alias("b"), "id", "vector")
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the cells

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out, x = [], x.sort_values("id")
        if len(x) and len(y):
            sims, ids = _unit(y["vector"]) @ _unit(x["vector"]).T, x["id"].to_numpy()
            for i, query in enumerate(y["id"]):
                best = np.argsort(-sims[i], kind="stable")[: k + 1]
                best = best[ids[best] != query][:k]
                out += [(query, ids[j], sims[i, j]) for j in best]
        return pd.DataFrame(out, columns=["query_id", "item_id", "cosine"]).astype({"cosine": "float64"})

    keys = ["p", "cell", "c", "b"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(near, f"query_id {dict(queries.dtypes)['id']}, item_id {dict(items.dtypes)['id']}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round((1 - (1 - F.col("cosine")) / 2) * 100, 2)))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "item_id", score.alias("score"), "rank")
