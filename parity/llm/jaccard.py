"""Exact n-gram Jaccard join with count vectors as points of an R-tree.

A document is the set of its distinct word shingles (64-bit hashes).  Shingles are grouped by the upper bits of their
hash and a set's group counts are its point; the summed coordinate minima of two points bound their overlap from
above, and so do the minima with the upper corner of a node's box.

Plain count vectors do not part large sets (their coordinates are all near n / GROUPS), so blocks come first: two sets
that link share a shingle among the n - ceil(t n) + 1 smallest hashes of each, their prefix.  This holds for any order of all
shingles, so those that very many documents share (a common line) count as the largest hashes: else each is a block whose sets have little else in
common, which grows with the corpus and, once its nodes melt, ties all of them into one family.  A prefix shingle that no
other set's prefix holds adds nothing to any overlap, so the ``LOW`` first groups become one coordinate that counts only
shingles met in a larger block; a set whose prefix ends inside them sends all of them to the blocks, so that what two
sets share there is met by both.  A small block gives its few pairs, and how many small blocks of the ``LOW`` groups a pair shares is counted and added
to its bound; in a larger block a one-pass insertion into leaf nodes joins what the bound allows to those that share no small block.  Sets that the bound
connects form families; a family is packed in leaves of bounded size, leaf pairs whose boxes cannot hold a link are
dropped, and the rest are verified exactly, skipping pairs that are already connected.

Shingles are 64-bit hashes of hashed words: two different ones of a pair of documents are taken for one with odds of n^2 to 2^64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, components, mix, signed, text_slices, window_hashes, word_hashes, word_spans, written

GROUPS = 64
LOW = 12  # groups, mostly below the prefix's end (about a quarter of all), that are counted by blocks
SMALL_BLOCK = 8  # blocks up to this size give their pairs one by one (28 at most)
NODE_ROWS = 32  # members of a node
OPEN_NODES = 4096  # nodes held open in a block; beyond, they melt into one whose corner stands for its members, and nothing is lost
LEAF_ROWS, LEAF_SHINGLES = 1024, 1 << 21
SEEN_SETS = 200_000  # signatures kept per task to send a repeated set once
COMMON_TEXTS = 256  # a shingle of about so many different texts or more is put last
COMMON_PART = 32  # they are looked for in one text of so many; which are found changes the blocks, never the links
COMMON_KEYS = 1 << 17  # the most that are put last (the commonest), which bounds what each task holds


class Late:
    """Shingles that are put last: each becomes one of the largest 64-bit numbers, the commonest the very last."""

    def __init__(self, commonest_first: np.ndarray) -> None:
        order = np.argsort(commonest_first)
        self.keys, self.codes = commonest_first[order], ~order.astype(np.uint64)
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[self.keys >> np.uint64(44)] = True

    def renamed(self, grams: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.some[grams >> np.uint64(44)])
        if not len(at):
            return grams
        nth = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[nth] == grams[at]
        grams[at[same]] = self.codes[nth[same]]
        return grams


NONE_LATE = Late(np.zeros(0, np.uint64))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, late: Late = NONE_LATE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer than k words has its whole sequence as one."""
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    words, _ = word_hashes(buf, starts, ends)
    grams = late.renamed(window_hashes(words, k))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(window_hashes(words[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)), int(mix(s + np.uint64(0x14057B7EF767814F)).sum().view(np.int64))


def point(s: np.ndarray) -> np.ndarray:
    """Counts by the upper bits; shingles that were put last are dealt to the groups from LOW on."""
    groups = (s >> np.uint64(58)).astype(np.int64)
    first = int(np.searchsorted(s, ~np.uint64(COMMON_KEYS)))
    groups[first:] = LOW + (~s[first:]).astype(np.int64) % (GROUPS - LOW)
    return np.bincount(groups, minlength=GROUPS).astype(np.int32)


def prefix(s: np.ndarray, percent: int) -> np.ndarray:
    return s[: len(s) - -(-percent * len(s) // 100) + 1]


def blocked(s: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that a set sends to the blocks: its prefix and all of the LOW first groups."""
    return s[: max(len(prefix(s, percent)), in_low(s))]


def in_low(s: np.ndarray) -> int:
    """How many shingles the LOW first groups hold."""
    return int(np.searchsorted(s, np.uint64(LOW << 58)))


def least_overlap(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest overlap of two sets of ``total`` elements together that reaches the similarity."""
    return -(-percent * total // (100 + percent))


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(docs: DataFrame, run: Callable[[pa.RecordBatch, int, int, list[np.ndarray]], pa.RecordBatch | None], schema: str, k: int, late: Late = NONE_LATE) -> DataFrame:
    def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in text_slices(batch.column("text")):
                out = run(batch, a, b, shingle_sets(buf, offs, k, late))
                if out is not None:
                    yield out

    return docs.mapInArrow(all_batches, schema)


def _late(docs: DataFrame, k: int) -> Late:
    """The shingles to put last."""

    def flat(batch: pa.RecordBatch, a: int, b: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sets)))], names=["shingle"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(COMMON_PART)) == 0).distinct()
    many = _texts(some, flat, "shingle long", k).groupBy("shingle").count().filter(F.col("count") >= COMMON_TEXTS // COMMON_PART)
    found = many.orderBy(F.desc("count"), "shingle").limit(COMMON_KEYS).select("shingle").toArrow()
    return Late(found.column("shingle").to_numpy().view(np.uint64))


def _described(docs: DataFrame, k: int, late: Late) -> DataFrame:
    """(doc_id, n, s1, s2, low, point) of every row: the point without the LOW first groups, and how many shingles those hold."""

    def run(batch: pa.RecordBatch, a: int, b: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        sigs = [signature(s) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in sigs], pa.int64()),
             pa.array([y for _, y in sigs], pa.int64()), pa.array([in_low(s) for s in sets], pa.int64()), pa.array([point(s)[LOW:].tobytes() for s in sets], pa.binary())],
            names=["doc_id", "n", "s1", "s2", "low", "point"],
        )

    return _texts(docs, run, "doc_id long, n long, s1 long, s2 long, low long, point binary", k, late)


def _prefixes(docs: DataFrame, k: int, percent: int, late: Late) -> DataFrame:
    """(shingle, n, s1): each set's blocked hashes; a task sends a repeated set once."""

    def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, buf, offs in text_slices(batch.column("text")):
                rows, sizes, ids = [], [], []
                for s in shingle_sets(buf, offs, k, late):
                    sid = signature(s)
                    if not len(s) or sid in seen:
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(sid)
                    rows.append(blocked(s, percent))
                    sizes.append(len(s))
                    ids.append(sid[0])
                if rows:
                    many = [len(r) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(rows))), pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(np.repeat(np.array(ids, np.int64), many))], names=["shingle", "n", "s1"])

    return docs.select("text").mapInArrow(all_batches, "shingle long, n int, s1 long")


def _blocks(prefixes: DataFrame, percent: int) -> DataFrame:
    """Rows (shingle, a, b, met): a pair of small blocks and how many of these lie in the LOW first groups (shingle null), a member a of a larger
    block (b null), or for a set a how many of its shingles in the LOW first groups were met in larger blocks (both null).

    Prefixes lie sorted by (shingle, n, s1) in their partition; a block is a run and is never held whole.
    """

    def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        large: int | None = None  # the shingle of a larger block that goes on
        tail: int | None = None

        def give(key: np.ndarray, n: np.ndarray, sid: np.ndarray, last: bool) -> pa.RecordBatch | None:
            nonlocal held, large, tail
            if not len(key):
                return None
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            fresh[0] = not (large == key[0] and tail == sid[0])
            key, n, sid = key[fresh], n[fresh], sid[fresh]
            if not len(key):
                return None
            edge = np.ones(len(key), dtype=bool)
            edge[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(key)))
            big = size > SMALL_BLOCK
            big[0] |= large == key[0]
            held = tuple(x[:0] for x in held)
            cut = len(key)
            if not last and not big[-1]:
                cut = start[-1]
                held = (key[cut:], n[cut:], sid[cut:])
            large, tail = (int(key[-1]), int(sid[-1])) if not last and big[-1] else (None, None)
            of_big = np.repeat(big, size)[:cut]
            left, right, of_low = [], [], []
            lowest = key[:cut].view(np.uint64) < np.uint64(LOW << 58)
            small = np.flatnonzero(~of_big)
            for d in range(1, SMALL_BLOCK):
                i = small[small + d < cut]
                i = i[key[i] == key[i + d]]
                i = i[100 * n[i].astype(np.int64) >= percent * n[i + d].astype(np.int64)]
                if not len(i):
                    break
                left.append(np.minimum(sid[i], sid[i + d]))
                right.append(np.maximum(sid[i], sid[i + d]))
                of_low.append(lowest[i])
            pairs, shared = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
            if left:
                pairs, nth = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0, return_inverse=True)
                shared = np.bincount(nth.reshape(-1), np.concatenate(of_low), minlength=len(pairs)).astype(np.int64)
            at = np.flatnonzero(of_big)
            m = len(pairs)
            shingle = pa.array(np.concatenate([np.zeros(m, np.int64), key[at]]), mask=np.arange(m + len(at)) < m)
            other = pa.array(np.concatenate([pairs[:, 1], np.zeros(len(at), np.int64)]), mask=np.arange(m + len(at)) >= m)
            who, met = np.unique(sid[:cut][lowest & of_big], return_counts=True)
            nothing = pa.nulls(len(who), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([shingle, nothing]), pa.array(np.concatenate([pairs[:, 0], sid[at], who])), pa.concat_arrays([other, nothing]),
                 pa.concat_arrays([pa.array(shared), pa.nulls(len(at), pa.int64()), pa.array(met.astype(np.int64))])],
                names=["shingle", "a", "b", "met"],
            )

        for batch in batches:
            new = [np.asarray(batch.column(c)) for c in ("shingle", "n", "s1")]
            out = give(*(np.concatenate([h, x]) for h, x in zip(held, new, strict=True)), last=False)
            if out is not None and out.num_rows:
                yield out
        out = give(*held, last=True)
        if out is not None and out.num_rows:
            yield out

    laid = prefixes.repartition("shingle").sortWithinPartitions("shingle", "n", "s1")
    return laid.mapInArrow(all_batches, "shingle long, a long, b long, met long")


def _points_of(batch: pa.RecordBatch, low: str, rest: str) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column(rest).to_pylist()), dtype=np.int32).reshape(-1, GROUPS - LOW)
    return np.concatenate([np.asarray(batch.column(low)).astype(np.int32)[:, None], flat], axis=1)


def _bounded_pairs(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose summed minima, with what they share in small blocks, reach the least overlap."""
    one = points.select(F.col("s1").alias("a"), F.col("n").alias("na"), F.col("large").alias("la"), F.col("point").alias("pa"))
    two = points.select(F.col("s1").alias("b"), F.col("n").alias("nb"), F.col("large").alias("lb"), F.col("point").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            bound = np.minimum(_points_of(batch, "la", "pa"), _points_of(batch, "lb", "pb")).sum(axis=1) + np.asarray(batch.column("shared"))
            yield batch.filter(pa.array(bound >= least_overlap(total, percent))).select(["a", "b"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


class Boxes:
    """The leaf nodes of one block's tree, filled in order of n: up to ``NODE_ROWS`` members of one cluster each, with their upper
    corner.  A node whose largest member is too small for what is to come closes.  A cluster is named by its first member, and its
    edges all lead there, so that the blocks of a family give the same edges again and not others."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.corner = np.zeros((0, 1 + GROUPS - LOW), np.int32)
        self.low_n, self.high_n, self.cluster = (np.zeros(0, np.int64) for _ in range(3))
        self.points: list[np.ndarray | None] = []  # None: melted, its corner stands for all its members
        self.sizes: list[list[int]] = []
        self.members: list[list[int]] = []

    def _keep(self, at: np.ndarray) -> None:
        self.corner, self.low_n, self.high_n, self.cluster = self.corner[at], self.low_n[at], self.high_n[at], self.cluster[at]
        for name in ("points", "sizes", "members"):
            old = getattr(self, name)
            setattr(self, name, [old[i] for i in at])

    def _melt(self) -> list[tuple[int, int]]:
        edges = [(self.members[0][0], m[0]) for m in self.members[1:]]
        corner, low, high = self.corner.max(axis=0), self.low_n.min(), self.high_n.max()
        self._keep(np.array([0]))
        self.corner[0], self.low_n[0], self.high_n[0], self.points[0] = corner, low, high, None
        return edges

    def _holds_partner(self, node: int, n: int, p: np.ndarray) -> bool:
        if self.points[node] is None:
            return True
        many = len(self.members[node])
        bound = np.minimum(self.points[node][:many], p).sum(axis=1)
        return bool((bound >= least_overlap(np.array(self.sizes[node]) + n, self.percent)).any())

    def insert(self, sid: int, n: int, p: np.ndarray) -> list[tuple[int, int]]:
        """Edges that connect the set with every cluster that holds a member which the bound allows."""
        near = 100 * self.high_n >= self.percent * n
        if not near.all():
            self._keep(np.flatnonzero(near))
        least = least_overlap(n + np.maximum(self.low_n, -(-self.percent * n // 100)), self.percent)
        joined: list[int] = []
        for node in np.flatnonzero(np.minimum(self.corner, p).sum(axis=1) >= least)[::-1].tolist():
            if self.cluster[node] not in joined and self._holds_partner(node, n, p):
                joined.append(int(self.cluster[node]))
        edges = [(c, sid) for c in joined]
        own = joined[-1] if joined else sid  # the oldest
        for c in joined[:-1]:
            self.cluster[self.cluster == c] = own
        last = np.flatnonzero(self.cluster == own)[-1:]
        if len(last) and (self.points[last[0]] is None or len(self.members[last[0]]) < NODE_ROWS):
            to = int(last[0])
            if self.points[to] is not None:
                self.points[to][len(self.members[to])] = p
                self.members[to].append(sid)
                self.sizes[to].append(n)
            np.maximum(self.corner[to], p, out=self.corner[to])
            self.low_n[to], self.high_n[to] = min(self.low_n[to], n), max(self.high_n[to], n)
            return edges
        room = np.zeros((NODE_ROWS, len(p)), np.int32)
        room[0] = p
        self.corner = np.concatenate([self.corner, p[None]])
        self.low_n, self.high_n, self.cluster = np.append(self.low_n, n), np.append(self.high_n, n), np.append(self.cluster, own)
        self.points.append(room)
        self.sizes.append([n])
        self.members.append([sid])
        return edges + (self._melt() if len(self.members) > OPEN_NODES else [])


def _block_edges(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) inside larger blocks: of sets that share no small block, what the bound connects there is connected by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, boxes = None, Boxes(percent)
        given: set[tuple[int, int]] = set()
        for batch in batches:
            edges: set[tuple[int, int]] = set()
            pts = _points_of(batch, "large", "point")
            for i, (k, sid, n) in enumerate(zip(*(np.asarray(batch.column(c)).tolist() for c in ("shingle", "s1", "n")), strict=True)):
                if k != key:
                    key, boxes = k, Boxes(percent)
                edges.update(boxes.insert(sid, n, pts[i]))
            edges -= given
            if len(given) > SEEN_SETS:
                given.clear()
            given |= edges
            pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    laid = members.join(points, "s1").select("shingle", "n", "s1", "large", "point").repartition("shingle").sortWithinPartitions("shingle", "n", "s1")
    return laid.mapInArrow(run, "a long, b long")


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: the blocks of a family name different heads a for one member b.  Each member keeps
    its smallest head, and that head an edge to the member's other heads, given once by a task.  A member has no more rows than blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least = None, 0
        given: set[tuple[int, int]] = set()
        for batch in batches:
            a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
            if not len(b):
                continue
            edge = np.ones(len(b), dtype=bool)
            edge[1:] = b[1:] != b[:-1]
            start = np.flatnonzero(edge)
            heads = a[start].copy()
            if b[0] == key:
                heads[0], edge[0] = least, False
            of = np.repeat(heads, np.diff(np.append(start, len(b))))
            key, least = int(b[-1]), int(heads[-1])
            others = {(x, y) for x, y in np.unique(np.stack([of, a], axis=1)[of != a], axis=0).tolist()} - given
            if len(given) > SEEN_SETS:
                given.clear()
            given |= others
            more = np.array(sorted(others), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[edge], more[:, 0]])), pa.array(np.concatenate([b[edge], more[:, 1]]))], names=["a", "b"])

    return edges.repartition("b").sortWithinPartitions("b", "a").mapInArrow(run, "a long, b long")


def _leaves(members: DataFrame) -> DataFrame:
    """(family, leaf, rep, n, low, point): families packed, in order of size and point, in leaves of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        leaf, rows, shingles, family = 0, 0, 0, None
        for batch in batches:
            out = []
            for f, n in zip(batch.column("family").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if f != family or rows == LEAF_ROWS or shingles + n > LEAF_SHINGLES:
                    leaf, rows, shingles, family = leaf + 1, 0, 0, f
                rows, shingles = rows + 1, shingles + n
                out.append(base + leaf)
            yield pa.RecordBatch.from_arrays([batch.column("family"), pa.array(out, pa.int64()), *(batch.column(c) for c in ("rep", "n", "low", "point"))], names=["family", "leaf", "rep", "n", "low", "point"])

    laid = members.select("family", "rep", "n", "low", "point").repartitionByRange("family", "n", "point").sortWithinPartitions("family", "n", "point", "rep")
    return laid.mapInArrow(run, "family long, leaf long, rep long, n long, low long, point binary")


def _leaf_pairs(leaves: DataFrame, percent: int) -> DataFrame:
    """(one, two) of leaves of one family, each with itself and with every other that the boxes' bound allows."""
    many = leaves.groupBy("family").agg(F.min("leaf").alias("x"), F.max("leaf").alias("y")).filter("x <> y").select("family")

    def box(pdf):
        pts = np.frombuffer(b"".join(pdf["point"]), dtype=np.int32).reshape(len(pdf), -1)
        return pdf.head(1)[["family", "leaf"]].assign(least=pdf["n"].min(), most=pdf["n"].max(), low=pdf["low"].max(), corner=[pts.max(axis=0).tobytes()])

    boxes = leaves.join(many, "family", "left_semi").groupBy("family", "leaf").applyInPandas(box, "family long, leaf long, least long, most long, low long, corner binary")
    boxes = written(boxes, "boxes")
    other = boxes.select("family", *(F.col(c).alias(c + "2") for c in ("leaf", "least", "most", "low", "corner")))
    near = (F.col("leaf") < F.col("leaf2")) & (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column("least")) + np.asarray(batch.column("least2"))
            bound = np.minimum(_points_of(batch, "low", "corner"), _points_of(batch, "low2", "corner2")).sum(axis=1)
            yield batch.filter(pa.array(bound >= least_overlap(total, percent))).select(["leaf", "leaf2"]).rename_columns(["one", "two"])

    crossing = boxes.join(other, "family").filter(near).mapInArrow(run, "one long, two long")
    return leaves.select(F.col("leaf").alias("one"), F.col("leaf").alias("two")).distinct().unionByName(crossing)


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = self.of[i], self.of[j]
        self.of[self.of == max(a, b)] = min(a, b)


def link_rows(rep: list[int], side: np.ndarray, sets: list[np.ndarray], percent: int, crossing: bool) -> list[tuple[int, int]]:
    """Links that connect all linked rows of a leaf, or of two leaves (side 0 and 1), verified on the sets."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    rep, side, sets, n = [rep[i] for i in order], side[order], [sets[i] for i in order], n[order]
    pts = np.stack([point(s) for s in sets])
    forest, out = Forest(len(rep)), []
    for i in range(len(rep) - 1):
        to = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        at = np.arange(i + 1, to)
        at = at[forest.of[at] != forest.of[i]]
        if crossing:
            at = at[side[at] != side[i]]
        if not len(at):
            continue
        at = at[np.minimum(pts[at], pts[i]).sum(axis=1) >= least_overlap(n[at] + n[i], percent)]
        for j in at.tolist():
            if forest.of[j] != forest.of[i] and links(sets[i], sets[j], percent):
                forest.join(i, j)
                out.append((rep[i], rep[j]))
    return out


def _verified(docs: DataFrame, leaves: DataFrame, pairs: DataFrame, k: int, percent: int, late: Late) -> DataFrame:
    """Links (a, b) between representatives."""
    flat = pairs.select(F.col("one").alias("leaf"), F.lit(0).alias("side"), "one", "two").unionByName(pairs.filter("one <> two").select(F.col("two").alias("leaf"), F.lit(1).alias("side"), "one", "two"))
    tasks = leaves.select("rep", "leaf").join(flat, "leaf").groupBy("rep").agg(F.collect_list(F.struct("one", "two", "side")).alias("tasks"))
    texts = docs.join(tasks, docs["doc_id"] == tasks["rep"]).select("rep", "text", "tasks")

    def sets(batch: pa.RecordBatch, a: int, b: int, found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a), batch.column("tasks").slice(a, b - a), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "tasks", "elements"])

    rows = _texts(texts, sets, "rep long, tasks array<struct<one:long,two:long,side:int>>, elements binary", k, late)
    rows = rows.select("rep", "elements", F.explode("tasks").alias("t")).select("t.one", "t.two", "t.side", "rep", "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(group)
            one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
            found = [np.frombuffer(e, dtype=np.uint64) for e in t.column("elements").to_pylist()]
            got = link_rows(t.column("rep").to_pylist(), t.column("side").to_numpy(), found, percent, one != two)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

        group: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            one, two = np.asarray(batch.column("one")), np.asarray(batch.column("two"))
            edge = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(one)], strict=True):
                if b > a:
                    if group and key != (one[a], two[a]):
                        yield solve(group)
                        group = []
                    key = (one[a], two[a])
                    group.append(batch.slice(a, b - a))
        if group:
            yield solve(group)

    return rows.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Words are runs without the six ASCII spaces, A-Z lower-cased; a document's set holds its distinct k-word shingles, or
    its whole sequence if it has fewer words.  Two documents link when 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable over links, the own one included.  Null, empty and blank texts have an
    empty set and link with nothing; copies link; of rows that share a doc_id each has its own set, and links
    of either reach both; an empty table gives no rows.  No link is lost at any size of block or family.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    late = _late(docs, k)
    info = written(_described(docs, k, late), "described")
    blocks = written(_blocks(_prefixes(docs, k, percent, late), percent), "blocks")
    met = blocks.filter("b is null and met is not null").groupBy("a").agg(F.sum("met").alias("met")).withColumnRenamed("a", "s1")
    sets = info.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("low").alias("low"), F.first("point").alias("point"))
    sets = written(sets.join(met, "s1", "left").select("s1", "s2", "n", "rep", "low", F.coalesce("met", F.lit(0)).alias("large"), "point"), "sets")
    points = sets.select("s1", "n", "large", "point")
    pairs = _bounded_pairs(blocks.filter("b is not null").groupBy("a", "b").agg(F.sum("met").alias("shared")), points, percent)
    inside = _contracted(_block_edges(blocks.filter("shingle is not null").select("shingle", F.col("a").alias("s1")), points, percent))
    families = components(pairs.unionByName(inside), "families").select(F.col("id").alias("s1"), F.col("component").alias("family"))
    leaves = written(_leaves(sets.join(families, "s1")), "leaves")
    found = written(_verified(docs, leaves, _leaf_pairs(leaves, percent), k, percent, late), "links")
    reached = components(found, "linked").select(F.col("id").alias("rep"), "component")
    classes = sets.select("s1", "s2", "n", "rep").join(reached, "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = info.join(classes, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
