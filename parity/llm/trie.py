"""A prefix trie of row sequences with member counts and subtree sums.

Nodes are the distinct prefix digests.  They are dealt in equal ranges (shards); in each, a minimal perfect hash gives every digest a
slot, verified by the digest that the slot holds, and counts are flat arrays that are summed through an array of parent
slots, deepest level first.  Where a node's parent is in another shard, the piece of the trie below it is a fragment; fragments
form a tree that is summed by pointer doubling, and what they hold is added to their parents in a second pass over the shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, parts, with_fields, written
from .sequences import chain_keys, chained

SPREAD = 1.5  # places a key has in each level of the hash
MOST_LEVELS = 200
PIECE_BYTES = 1 << 20
SHARD = 1 << 20  # nodes of a shard, about
_STEP = 0x9E3779B97F4A7C15
_ZERO = np.zeros(1, np.uint64)
ROOT = tuple(int(k[0]) for k in chain_keys(_ZERO, _ZERO, np.zeros(1, np.int64)))


class NodeTable:
    """Minimal perfect hash of distinct digests: a level's keys that land alone are placed by rank, the others go on to the next
    level.  ``find`` gives the slot of a digest, or -1 if the slot holds another."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray) -> None:
        self.k1, self.k2, self.levels = np.empty_like(k1), np.empty_like(k2), []
        self.slot = np.empty(len(k1), dtype=np.int64)
        left, placed = np.arange(len(k1)), 0
        while len(left):
            if len(self.levels) == MOST_LEVELS:
                raise ValueError("digests are not distinct")
            size = int(SPREAD * len(left)) + 1
            at = self._at(k1[left], k2[left], len(self.levels), size)
            taken = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(taken) - 1 + placed
            alone = taken[at]
            self.slot[left[alone]] = rank[at[alone]]
            self.levels.append((size, taken, rank))
            left, placed = left[~alone], placed + int(taken.sum())
        self.k1[self.slot], self.k2[self.slot] = k1, k2

    @staticmethod
    def _at(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(mix(k1.view(np.uint64) + np.uint64(level * _STEP % 2**64)) ^ k2.view(np.uint64)) % np.uint64(size)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(k1), -1), np.arange(len(k1))
        for level, (size, taken, rank) in enumerate(self.levels):
            at = self._at(k1[open_], k2[open_], level, size)
            hit = taken[at]
            slot, key = rank[at[hit]], open_[hit]
            out[key] = np.where((self.k1[slot] == k1[key]) & (self.k2[slot] == k2[key]), slot, -1)
            open_ = open_[~hit]
        return out


class Shard:
    """The nodes of one range as flat arrays by slot."""

    def __init__(self, nodes: pa.Table) -> None:
        get = lambda name, fill=0: np.asarray(nodes.column(name).combine_chunks().fill_null(fill))
        self.table = NodeTable(get("k1"), get("k2"))
        n, slot = nodes.num_rows, self.table.slot
        self.parent = np.full(n, -1)
        root = np.asarray(nodes.column("p1").combine_chunks().is_null())
        self.parent[slot] = np.where(root, -1, self.table.find(get("p1"), get("p2")))
        depth, self.leaves, self.saved = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        depth[slot], self.leaves[slot], self.saved[slot] = get("depth"), get("leaves"), get("saved")
        order = np.argsort(depth, kind="stable")
        self.by_depth = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []

    def add_up(self) -> None:
        """Sums over the subtree, as far as it is in the shard."""
        for level in reversed(self.by_depth):
            inner = level[self.parent[level] >= 0]
            np.add.at(self.leaves, self.parent[inner], self.leaves[inner])
            np.add.at(self.saved, self.parent[inner], self.saved[inner])

    def tops(self) -> np.ndarray:
        """The slot of the highest node above each slot within the shard."""
        top = np.arange(len(self.parent))
        for level in self.by_depth:
            inner = level[self.parent[level] >= 0]
            top[inner] = top[self.parent[inner]]
        return top


def _ends(members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, id): the SHA-256 of the ids of a node in ascending order, joined by commas.

    Ranges of sorted ids hash the nodes that they hold alone.  A node that spans ranges is handed on as pieces of joined ids and hashed
    as a stream: SHA-256 is sequential, so that a node with a third of all ends is one task's pass over their digits, in bounded memory.
    """
    by = ["k1", "k2", "id"]
    schema = "k1 long, k2 long, part int, seq long, piece binary, ends_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held, size, seq, whole, seen = TaskContext.get().partitionId(), None, [], 0, 0, False, 0
        rows = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, ids = (np.asarray(batch.column(c)) for c in by)
            bounds = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(ids)], strict=True):
                if key != (k1[a], k2[a]):
                    if held:
                        text = b",".join(held)
                        rows.append((*key, part, seq, None, hashlib.sha256(text).hexdigest()) if whole and not seq else (*key, part, seq, text, None))
                    whole, seen, key, held, size, seq = seen > 0, seen + 1, (k1[a], k2[a]), [], 0, 0
                for c in range(a, b, 1 << 16):
                    held.append(",".join(map(str, ids[c : min(b, c + (1 << 16))].tolist())).encode())
                    size += len(held[-1])
                    if size >= PIECE_BYTES:
                        yield batch_of([(*key, part, seq, b",".join(held), None)])
                        held, size, seq = [], 0, seq + 1
            if len(rows) > 4096:
                yield batch_of(rows)
                rows = []
        if held:
            rows.append((*key, part, seq, b",".join(held), None))
        if rows:
            yield batch_of(rows)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for k1, k2, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "piece")), strict=True):
                if key != (k1, k2):
                    if key:
                        rows.append((*key, None, None, None, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(piece)
                else:
                    state.update(b",")
                    state.update(piece)
            if rows:
                yield batch_of(rows)
        if key:
            yield batch_of([(*key, None, None, None, state.hexdigest())])

    done = written(members.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(cut, schema), "ends")
    open_ = done.filter("piece is not null").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part", "seq").mapInArrow(stream, schema)
    return done.filter("piece is null").unionByName(open_).select("k1", "k2", "ends_sha256")


def _fragment_sums(fragments: DataFrame) -> DataFrame:
    """fragments: (t1, t2, leaves, saved, j1, j2), j the fragment above (null: none).  leaves and saved become sums over the fragments at and
    below each, in as many rounds as the logarithm of the tree's height: a round adds what is held one stride below, then doubles the stride."""
    now = written(fragments, "fragments")
    while not now.filter("j1 is not null").isEmpty():
        under = now.filter("j1 is not null").groupBy("j1", "j2").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).toDF("t1", "t2", "l", "s")
        above = now.select(F.col("t1").alias("j1"), F.col("t2").alias("j2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
        next_ = now.join(under, ["t1", "t2"], "left").join(above, ["j1", "j2"], "left")
        total = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
        now = written(next_.select("t1", "t2", total("leaves", "l"), total("saved", "s"), F.col("n1").alias("j1"), F.col("n2").alias("j2")), "fragments")
    return now.select("t1", "t2", "leaves", "saved")


def _subtree_sums(nodes: DataFrame, many: int) -> DataFrame:
    """nodes (``many``) with leaves and saved summed over their subtrees, in as many shards as keep one to about a million nodes."""
    schema = with_fields(nodes, ("part", "int"), ("t1", "long"), ("t2", "long"), ("own_leaves", "long"), ("own_saved", "long"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), pa.Table.from_batches(b) if (b := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        shard = Shard(rows)
        slot, own = shard.table.slot, [rows.column("leaves"), rows.column("saved")]
        shard.add_up()
        top = shard.tops()[slot]
        rows = rows.set_column(rows.schema.get_field_index("leaves"), "leaves", pa.array(shard.leaves[slot])).set_column(rows.schema.get_field_index("saved"), "saved", pa.array(shard.saved[slot]))
        more = [pa.array(np.full(len(slot), part, np.int32)), pa.array(shard.table.k1[top]), pa.array(shard.table.k2[top]), *own]
        for name, col in zip(("part", "t1", "t2", "own_leaves", "own_saved"), more, strict=True):
            rows = rows.append_column(name, col)
        yield from rows.to_batches()

    by, shards = ["conv_id", "depth"], max(parts(nodes.sparkSession), -(-many // SHARD))
    laid = written(nodes.repartitionByRange(shards, *by).sortWithinPartitions(*by).mapInArrow(first, schema), "shards")
    tops = laid.filter("k1 = t1 and k2 = t2").select("t1", "t2", "p1", "p2", "leaves", "saved")
    above = laid.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("t1").alias("j1"), F.col("t2").alias("j2"))
    tops = written(tops.join(above, ["p1", "p2"], "left"), "tops")
    if tops.filter("j1 is not null").isEmpty():
        return laid.select(*nodes.columns)
    sums = _fragment_sums(tops.select("t1", "t2", "leaves", "saved", "j1", "j2"))
    held = tops.filter("j1 is not null").select("t1", "t2", "p1", "p2").join(sums, ["t1", "t2"]).groupBy("p1", "p2").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    more = laid.join(held.toDF("k1", "k2", "l", "s"), ["k1", "k2"], "left")
    plus = lambda own, x: (F.col(own) + F.coalesce(F.col(x), F.lit(0))).alias(own.removeprefix("own_"))
    more = more.select("part", *[c for c in nodes.columns if c not in ("leaves", "saved")], plus("own_leaves", "l"), plus("own_saved", "s"))

    def second(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        shard.add_up()
        slot, out = shard.table.slot, rows.drop_columns(["part"])
        for name, values in (("leaves", shard.leaves), ("saved", shard.saved)):
            out = out.set_column(out.schema.get_field_index(name), name, pa.array(values[slot]))
        return out

    return more.groupBy("part").applyInArrow(second, more.drop("part").schema).select(*nodes.columns)


def prefix_trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The trie of sequences.  rows: (conv_id, at, digest, chars), places 0, 1, 2 ... of each sequence, equal digests for equal rows; members: (conv_id,
    length), every sequence once, also those without rows.  Further columns are left out; no row has a null.

    One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Without members there is no node, not even the root.  A sequence is never one task's work: it is cut where ranges end.
    """
    steps = chained(rows, "conv_id", "digest", ["chars"]).join(members.select("conv_id", F.col("length").alias("__length")), "conv_id")
    steps = written(steps.select("conv_id", (F.col("at") + 1).alias("depth"), "chars", "k1", "k2", "p1", "p2", (F.col("at") + 1 == F.col("__length")).alias("end")), "steps")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(F.lit(ROOT[0]).alias("k1"), F.lit(ROOT[1]).alias("k2"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    found = steps.groupBy("k1", "k2").agg(*(F.min(c).alias(c) for c in ("p1", "p2", "depth", "chars", "conv_id")), F.count("*").alias("n_convs"))
    nodes = written(found.unionByName(root), "nodes")
    many = nodes.count()
    kids = nodes.filter("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).toDF("k1", "k2", "n_children")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(kids, ["k1", "k2"], "left").join(above, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}).drop("chars")
    summed = _subtree_sums(nodes, many)
    ends = steps.filter("end").select("k1", "k2", F.col("conv_id").alias("id"))
    ends = _ends(ends.unionByName(members.filter("length = 0").select(F.lit(ROOT[0]).alias("k1"), F.lit(ROOT[1]).alias("k2"), F.col("conv_id").alias("id"))))
    done = summed.join(ends, ["k1", "k2"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
