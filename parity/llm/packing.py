"""Packing documents into fixed windows of tokens by non-negative least squares.

Documents are tokenised once and cut into whole windows and one remainder.  Only the histogram of piece lengths (at
most ``window`` rows) reaches the driver: shallow combinations of lengths that fill a window are enumerated, their
repeat counts solved against the histogram by non-negative least squares, rounded, and what is left is packed
greedily, pattern by pattern.  The plan is a table of slots; pieces take slots by their rank within their length.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import PERHAPS_RARE, byte_chars, rare
from .common import parts, text_slices, with_fields, written

# Fixed value: the published word pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 1
CACHE_WORDS, CACHE_BYTES = 300_000, 1 << 25  # words, and bytes of words and ids, that a worker keeps
SWEEPS = 20  # of coordinate descent
TRIPLES = 8  # combinations of three enumerated for a length


class Crowded(Exception):
    """A space stands beside white space or an end: not a safe place to split."""


class Words(dict):
    """Ids of the words that follow a single space, learned on first sight."""

    def __init__(self, ids: Callable[[str], bytes]) -> None:
        self.ids = ids
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Crowded
        self[word] = out = self.ids(" " + word)
        self.held += len(word) + len(out)
        return out


class ByteEncoder:
    """A byte-level BPE tokenizer file; words behind single spaces are encoded once and kept."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = Words(self.ids)

    def ids(self, text: str) -> bytes:
        """Ids of a text without special tokens; rare characters take the library itself."""
        if not text.isascii() and PERHAPS_RARE.search(text) and rare().search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers, equal to the library's."""
        if any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.split(" ")
        if not words or not first or first[-1].isspace():
            return self.ids(text)
        if len(self.known) > CACHE_WORDS or self.known.held > CACHE_BYTES:
            self.known.clear()
            self.known.held = 0
        try:
            return b"".join([self.ids(first), *map(self.known.__getitem__, words)])
        except Crowded:
            return self.ids(text)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> ByteEncoder:
    return ByteEncoder(path)


PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, path: str, window: int = 2048) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's ids and the end id, cut in windows and a remainder.

    ids are little-endian unsigned 32-bit.  Null and empty texts have the end id alone; repeated rows count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            col = batch.column("text")
            for a, b, _, _ in text_slices(col):
                rows = []
                for i, t in zip(ids.slice(a, b - a).to_pylist(), col.slice(a, b - a).to_pylist(), strict=True):
                    blob = encoder.encode(t or "") + end
                    n = len(blob) // 4
                    rows += [(i, s, min(window, n - s), n, blob[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of the lengths present that fill a window exactly: one, two or three pieces."""
    have = np.flatnonzero(hist)
    have = have[have > 0]
    out: set[tuple[int, ...]] = {(window,)} if hist[window] else set()
    present = set(have.tolist())
    out |= {(int(a), int(window - a)) for a in have if 2 * a >= window and window - a in present}
    frequent = have[np.argsort(-hist[have], kind="stable")]
    for a in have.tolist():
        found = 0
        for b in frequent.tolist():
            c = window - a - b
            if c > 0 and c in present:
                out.add(tuple(sorted((a, b, c), reverse=True)))
                found += 1
                if found == TRIPLES:
                    break
    return sorted(out)


def non_negative(hist: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts x >= 0 that least-squares fit (sum of x over combinations holding a length) to the histogram."""
    cols = []
    for c in combos:
        lengths, times = np.unique(c, return_counts=True)
        cols.append((lengths, times.astype(float), float((times**2).sum())))
    x, left = np.zeros(len(combos)), hist.astype(float)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (lengths, times, norm) in enumerate(cols):
            step = max(-x[j], float(times @ left[lengths]) / norm)
            if step:
                x[j] += step
                left[lengths] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, how often): together they use every piece of the histogram exactly once."""
    left, out = hist.astype(np.int64).copy(), []
    combos = combinations(hist, window)
    x = non_negative(hist, combos)
    for j in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(combos[j], return_counts=True)
        n = min(int(np.floor(x[j] + 1e-6)), int((left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append((combos[j], n))
    while (have := np.flatnonzero(left)).size:
        lengths, used = [], np.zeros_like(left)
        space = window
        while space:
            fits = have[(have <= space) & (left[have] > used[have])]
            if not fits.size:
                break
            lengths.append(int(fits[-1]))
            used[fits[-1]] += 1
            space -= int(fits[-1])
        kinds = np.flatnonzero(used)
        n = int((left[kinds] // used[kinds]).min())
        left[kinds] -= n * used[kinds]
        out.append((tuple(lengths), n))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length the ranges of ranks [first, first + repeats) that a slot of a pattern takes."""
    rows, taken, sequence = [], {}, 0
    for lengths, n in patterns:
        at = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), sequence, at))
            taken[length] = taken.get(length, 0) + n
            at += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def place(cut: DataFrame, window: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset.  Ranks are counted in salted groups, so a length that a third of all
    pieces share is no single task's work; the plan has a bounded number of slots and goes to the tasks as it is."""
    salts = max(16, parts(cut.sparkSession))
    salt = F.pmod(F.xxhash64("doc_id", "start", *(["ids_crc32"] if "ids_crc32" in cut.columns else [])), F.lit(salts))
    cut = cut.withColumn("__salt", salt)
    groups = cut.groupBy("length", "__salt").count()
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``window`` rows
        hist[r["length"]] = r["n"]
    table = slots(plan(hist, window))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "start", *(["ids_crc32"] if "ids_crc32" in cut.columns else ["ids"]))
    ranked = cut.withColumn("__rank", F.row_number().over(within) - 1).join(base, ["length", "__salt"])
    kept = [c for c in cut.columns if c != "__salt"]
    ranked = ranked.select(*kept, (F.col("__rank") + F.col("__base")).cast("long").alias("__rank"))
    key = table["length"].to_numpy(np.int64) * (1 << 48) + table["first"].to_numpy(np.int64)
    first, sequence, offset = (table[c].to_numpy(np.int64) for c in ("first", "sequence", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = np.asarray(batch.column("__rank")), np.asarray(batch.column("length"))
            slot = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            cols = [batch.column(c) for c in kept] + [pa.array(sequence[slot] + rank - first[slot]), pa.array(offset[slot])]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, with_fields(cut.select(*kept), ("sequence_id", "long"), ("offset", "long")))


def pack(docs: DataFrame, path: str, window: int = 2048, keep_ids: bool = True) -> DataFrame:
    """Documents (doc_id, text) packed: one row per piece with doc_id, start, length, doc_tokens, the CRC-32 of its ids (ids_crc32) and, with
    keep_ids, the ids, sequence_id and offset.  An empty table gives no rows; a null doc_id is packed like any other.

    Pieces are placed by their lengths alone: the ids stay in the written table and are joined to their places at last.
    """
    cut = pieces(docs, path, window).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        return place(written(cut.drop("ids"), "pieces"), window)
    cut = written(cut.withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    return place(cut.drop("ids"), window).join(cut.select("__piece", "ids"), "__piece").drop("__piece")
