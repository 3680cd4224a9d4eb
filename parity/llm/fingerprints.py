"""Document fingerprints by locally consistent parsing.

Runs of equal symbols become one symbol; deterministic coin tossing then reduces the symbols to six labels whose
neighbours differ, by four looks at the left neighbour only; a phrase starts at every local maximum of the labels and is
named by a hash of its symbols, and the names are the next level's symbols.  Where a phrase starts depends on
a few neighbouring symbols, so equal substrings get equal phrases inside, whatever their offset.  A fingerprint
is the bottom-k sketch of the phrase names of level ``LEVEL``, repeats told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_POWERS, mix, span_hash, text_slices, with_fields

LEVEL = 3  # phrases of about 25 bytes
SKETCH = 64  # names kept: a bag up to this size is kept whole
TOSSES = 4  # 2^64 names -> 128 -> 14 -> 8 -> 6 labels
RANGE_ROWS = 1000  # documents of one range of ids


def _collapse(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One symbol for each run of equal symbols of a document, the number of each document's first, and where runs begin and how long they are."""
    edge = np.ones(len(sym), dtype=bool)
    edge[1:] = sym[1:] != sym[:-1]
    edge[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(edge)
    many = np.diff(np.append(at, len(sym)))
    out = sym[at]
    long = many > 1
    out[long] = mix(out[long] + np.uint64(0x632BE59BD9B4E019) * many[long].astype(np.uint64))
    return out, np.searchsorted(at, first), at, many


def _phrases(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the phrases of all documents; sym has no equal neighbours but by hash chance, which ends a phrase."""
    n = len(sym)
    head = np.zeros(n + 1, dtype=bool)
    head[first] = True
    head = head[:-1]
    label = sym
    for _ in range(TOSSES):
        other = np.empty_like(label)
        other[1:] = label[:-1]
        other[0] = 0
        other[head] = ~label[head]  # a document's first symbol differs from the one before it in bit 0
        low = label ^ other
        low &= ~low + np.uint64(1)
        bit = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
        label = bit * np.uint64(2) + ((label & low) != 0)
    small = label.astype(np.int8)
    left, right = np.empty(n, np.int8), np.empty(n, np.int8)
    left[1:], right[:-1] = small[:-1], small[1:]
    left[0], right[-1] = 99, 99
    left[head] = 99  # no local maximum beside a forced start
    right[:-1][head[1:]] = 99
    return np.flatnonzero(head | ((small > left) & (small >= right)))


def parse(buf: np.ndarray, offs: np.ndarray, level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Names of the level's phrases of all documents and the document of each.

    A run of equal symbols is one symbol and would be one name, however long; it also gives its symbol's name once for every
    phrase's worth of it, so that repetitive texts keep their weight.
    """
    sym, first = mix(np.arange(1, 257, dtype=np.uint64))[buf], offs
    names, owners = [], []
    for k in range(level):
        if not len(sym):
            break
        worth = 3 ** (level - k)
        whole, before = sym, first
        sym, first, at, many = _collapse(sym, first)
        long = many >= 2 * worth
        names.append(np.repeat(mix(whole[at[long]] + np.uint64(0x9FB21C651E98DF25)), many[long] // worth))
        owners.append(np.repeat(np.searchsorted(before, at[long], side="right") - 1, many[long] // worth))
        starts = _phrases(sym, first)
        ends = np.append(starts[1:], len(sym))
        sym = span_hash(sym, starts, ends, WORD_POWERS) + np.uint64(k)
        first = np.searchsorted(starts, first)
    names.append(sym)
    owners.append(np.repeat(np.arange(len(offs) - 1), np.diff(first)))
    return np.concatenate(names), np.concatenate(owners).astype(np.uint64)


def sketches(buf: np.ndarray, offs: np.ndarray, level: int = LEVEL) -> list[np.ndarray]:
    """The smallest ``SKETCH`` 32-bit names of each document's phrases, sorted; the i-th time a phrase occurs has a name of its own."""
    names, doc = parse(buf, offs, level)
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    fresh = np.ones(len(names), dtype=bool)
    fresh[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    time = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    names = np.where(time > 0, mix(names + np.uint64(0x2545F4914F6CDD1D) * time.astype(np.uint64)), names)
    both = np.unique(doc << np.uint64(32) | names >> np.uint64(32))
    cut = np.searchsorted(both, np.arange(len(offs), dtype=np.uint64) << np.uint64(32))
    low = (both & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [low[a : min(b, a + SKETCH)] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def sketch_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase bags (exact for bags within the sketch); 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(both, union[-1], side="right")) / len(union)


def of_texts(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, buf, offs in text_slices(pa.array(texts, pa.large_string())):
        out += sketches(buf, offs)
    return out


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the fingerprint (hex) of a text column: null and empty texts have the empty fingerprint, equal texts equal ones."""
    df = df.drop(name) if name != text else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, buf, offs in text_slices(batch.column(text)):
                out += [s.tobytes().hex() for s in sketches(buf, offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, with_fields(df, (name, "string")))


def _ranged(docs: DataFrame) -> DataFrame:
    """(range, guest, place, doc_id, text): documents dealt by ranges of ids; each range also has, as a guest, the document that
    follows its last (the first one of all after the last range).  One shuffle of the texts, no global window."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    n = docs.count()
    cuts = min(max(n // RANGE_ROWS, 1), 20_000)
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)]) if cuts > 1 else F.array(F.lit(0.5))
    got = docs.agg(F.min("place").alias("low"), F.percentile_approx("place", shares, 10 * max(cuts, 1000)).alias("cuts")).first()
    low = got["low"]
    splits = np.unique([c for c in (got["cuts"] or []) if c > low]).astype(np.int64) if n and cuts > 1 else np.zeros(0, np.int64)
    last = len(splits)

    @F.pandas_udf("array<int>")
    def homes(place: pd.Series) -> pd.Series:
        own = np.searchsorted(splits, place.to_numpy(), side="right")
        opens = np.append(np.int64(low if low is not None else 0), splits)[own] == place.to_numpy()
        return pd.Series([[int(r), int(r - 1) if r else int(last)] if o else [int(r)] for r, o in zip(own, opens, strict=True)])

    dealt = docs.select("doc_id", "text", "place", F.posexplode(homes("place")).alias("guest", "range"))
    return dealt.repartition("range").sortWithinPartitions("range", "guest", "place", "text")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """For each document (doc_id, text) its fingerprint, that of the edited text and both likenesses.

    Documents follow each other by ascending doc_id (null first, equal ids by text; the first follows the last).  Edited: the last
    floor(n / 4) code points are replaced by the first as many (or all) of the next document.  A null text counts as
    empty; an only document follows itself; an empty table gives no rows.
    """
    schema = with_fields(
        docs.select("doc_id"), ("n_chars", "long"), ("edited", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (range, guest, id, text, sketch) of the last row read

        def rows_of(part: pa.RecordBatch) -> list[tuple]:
            texts = part.column("text").to_pylist()
            cols = [part.column(c).to_pylist() for c in ("range", "guest", "doc_id")]
            return list(zip(*cols, texts, of_texts(texts), strict=True))

        def pairs(rows: list[tuple]) -> pa.RecordBatch | None:
            done = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] == b[0] and not a[1]]
            if not done:
                return None
            edited = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in done]
            marks = of_texts(edited)
            cols = [
                pa.array([a[2] for a, _ in done], schema_id), pa.array([len(a[3]) for a, _ in done], pa.int64()), pa.array(edited, pa.string()),
                pa.array([a[4].tobytes().hex() for a, _ in done]), pa.array([m.tobytes().hex() for m in marks]),
                pa.array([sketch_likeness(a[4], m) for (a, _), m in zip(done, marks, strict=True)]),
                pa.array([sketch_likeness(a[4], b[4]) for a, b in done]),
            ]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        schema_id = None
        for batch in batches:
            schema_id = batch.column("doc_id").type
            for a, b, _, _ in text_slices(batch.column("text")):
                rows = held + rows_of(batch.slice(a, b - a))
                out = pairs(rows)
                held = rows[-1:]
                if out is not None:
                    yield out

    return _ranged(docs).mapInArrow(run, schema)

