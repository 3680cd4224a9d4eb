"""Helpers that several operators share: byte-level word spans and hashes in numpy, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from parity.operators.scratch import shared_folder, written  # noqa: F401

SLICE_BYTES = 1 << 19  # text handled at once by a numpy pass; a longer document is one slice of its own

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE_BYTE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_WORD = np.uint64(0xD1342543DE82EF95)
_BASE_CHECK = np.uint64(0xAF251AF3B0F025B5)
SEED = 0x51ED270B


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv = base, _inverse(base)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up = np.full(size, self.base, dtype=np.uint64)
            down = np.full(size, self.inv, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


BYTE_POWERS, WORD_POWERS, CHECK_POWERS = Powers(_BASE_BYTE), Powers(_BASE_WORD), Powers(_BASE_CHECK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(digits: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Rabin-Karp hashes (mod 2^64, mixed) of the spans of a digit array, whatever their offset."""
    up, down = powers.need(len(digits) + 1)
    total = np.zeros(len(digits) + 1, dtype=np.uint64)
    np.cumsum(digits * up[: len(digits)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def text_slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts of about ``most`` bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per text, the number of its first word (n + 1 long)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word, the halves of its XXH3-128: each different word of the buffer is hashed once.
    starts and ends are all words of the buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    offs = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offs[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(buf[~SPACE[buf]]))])
    coded = words.dictionary_encode()
    kinds = coded.dictionary
    flat, ends = kinds.buffers()[2].to_pybytes(), np.frombuffer(kinds.buffers()[1], dtype=np.int64)[: len(kinds) + 1].tolist()
    digests = b"".join([xxh3_128_digest(flat[a:b], SEED) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    halves = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)[np.asarray(coded.indices)]
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def window_hashes(words: np.ndarray, k: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """Rabin-Karp hashes of every run of k entries of one flat array (those across two texts are the caller's to leave out)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(m)
    return span_hash(words, at, at + k, powers)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The frame's schema and these (name, type) fields."""
    more = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields)) if fields else T.StructType()
    return T.StructType([*df.schema.fields, *more.fields])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for every id that has an edge.

    Rounds of contraction: every id takes the name of the neighbour (or of itself) that has most edges, ties by a hash that is new
    each round; edges between names remain, once each.  A star is one name after one round, a path of n ids after about log n.  Counting and naming are
    pre-aggregated, and a round's joins have a row for each end of an edge, so that a hub is never expanded.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    names: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = both.groupBy("a").agg(F.struct(F.count("*").alias("n"), F.xxhash64(F.lit(len(names)), "a").alias("h"), F.col("a").alias("to")).alias("own"))
        best = both.join(own.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max("own").alias("best"))
        named = written(own.join(best, "a").select("a", F.greatest("own", "best")["to"].alias("to")), name)
        one, two = named.toDF("a", "x"), named.toDF("b", "y")
        e = written(e.join(one, "a").join(two, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), name)
        names.append(named)
    if not names:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    last = names[-1]
    for named in reversed(names[:-1]):
        last = named.join(last.toDF("to", "end"), "to", "left").select("a", F.coalesce("end", "to").alias("to"))
    last = written(last, name)
    least = last.groupBy("to").agg(F.min("a").alias("component"))
    return last.join(least, "to").select(F.col("a").alias("id"), "component")
