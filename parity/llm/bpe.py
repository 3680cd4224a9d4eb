"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of all words of a batch lie in one flat array.  A round looks up the rank of every adjacent pair by
binary search over the sorted pair keys, takes each word's lowest rank by one segmented minimum and merges all its
places at once; words without a known pair leave the array.  A word longer than ``LONG_WORD`` bytes would take a round over all of itself
for every rank it holds, so its pairs wait in a heap instead; both orders give the same ids.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import text_slices, with_fields

CACHE_WORDS, CACHE_BYTES = 600_000, 1 << 26  # words, and bytes of words and ids, that a worker keeps; its cache starts anew beyond
LONG_WORD = 1024
NO_RANK = np.int64(1 << 40)


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


@functools.cache
def rare() -> re.Pattern:
    """Characters on which Python and the tokenizers library may disagree: those that Python's Unicode tables do not
    know, and the four controls that only Python takes for white space."""
    unknown = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], unknown, [False]]).astype(np.int8)))
    spans = [f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return re.compile("[\x1c-\x1f" + "".join(spans) + "]")


CONTROLS = re.compile("[\x1c-\x1f]")
PERHAPS_RARE = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")  # all below is known
SPACES = re.compile("[^\\S\x1c-\x1f]+")


class MergeTable:
    """A tokenizer file of kind BPE with word ends, ready for numpy."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            names[i] = t
        self.names = pa.array(names, pa.string())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def split_word(self, unit: str) -> list[bytes]:
        """The words of a run without white space, normalised; rare characters take the library's own splitter."""
        if not unit.isascii() or CONTROLS.search(unit):
            if PERHAPS_RARE.search(unit) and rare().search(unit):
                clean = self.library.normalizer.normalize_str(unit)
                return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]
            unit = unicodedata.normalize("NFC", unit)
        return [w.encode() for w in self.pattern.findall(lowered(unit))]

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, its pairs taken from a heap by rank, then place."""
        flat, pairs = np.frombuffer(word, dtype=np.uint8), self.pairs
        sym = self.inner[flat].tolist()
        sym[-1] = int(self.last[flat[-1]])
        after, before = [*range(1, len(sym)), -1], list(range(-1, len(sym) - 1))
        heap = [(pairs[k][0], i) for i, k in enumerate((self.inner[flat[:-1]] << 24 | np.array(sym[1:])).tolist()) if k in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            found = pairs.get(sym[i] << 24 | sym[j]) if sym[i] >= 0 and j >= 0 else None
            if found is None or found[0] != rank:
                continue  # one of the two has been merged since
            sym[i], sym[j], after[i] = found[1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (new := pairs.get(sym[a] << 24 | sym[after[a]])):
                    heapq.heappush(heap, (new[0], a))
        return np.array([x for x in sym if x >= 0], dtype=np.int64)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty word."""
        if any(len(w) > LONG_WORD for w in words):
            short = iter(self.merge([w for w in words if len(w) <= LONG_WORD]))
            return [self.merge_long(w) if len(w) > LONG_WORD else next(short) for w in words]
        lens = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last[flat[ends]]
        wid = np.repeat(np.arange(len(words)), lens)
        done_sym, done_wid = [], []
        while len(sym):
            new = np.ones(len(sym), dtype=bool)
            new[1:] = wid[1:] != wid[:-1]
            starts = np.flatnonzero(new)
            rank = np.full(len(sym), NO_RANK)
            made = np.zeros(len(sym), dtype=np.int64)
            key = sym[:-1] << 24 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[at] == key) & ~new[1:])
            rank[hit], made[hit] = self.ranks[at[hit]], self.made[at[hit]]
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            idle = least == NO_RANK
            if idle.any():
                done_sym.append(sym[idle])
                done_wid.append(wid[idle])
            pick = np.flatnonzero((rank == least) & ~idle)
            if len(pick):  # of overlapping places in a run of equal symbols, every second one
                run = np.ones(len(pick), dtype=bool)
                run[1:] = pick[1:] != pick[:-1] + 1
                first = pick[run][np.cumsum(run) - 1]
                pick = pick[(pick - first) % 2 == 0]
                sym[pick] = made[pick]
                idle[pick + 1] = True
            sym, wid = sym[~idle], wid[~idle]
        all_sym, all_wid = np.concatenate(done_sym or [sym]), np.concatenate(done_wid or [wid])
        all_sym = all_sym[np.argsort(all_wid, kind="stable")]
        return np.split(all_sym, np.cumsum(np.bincount(all_wid, minlength=len(words)))[:-1])


def lowered(text: str) -> str:
    """Lower case character by character: a final sigma gets no form of its own."""
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


@functools.lru_cache(maxsize=4)
def table_of(path: str) -> MergeTable:
    return MergeTable(path)


class Encoder:
    """Texts to ids, with caches of words seen by this worker."""

    def __init__(self, table: MergeTable) -> None:
        self.table = table
        self.units: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.held = 0  # bytes of words and ids

    def _learn(self, units: list[str]) -> None:
        split = [self.table.split_word(u) for u in units]
        fresh = list({w for ws in split for w in ws if w not in self.words})
        if fresh:
            for w, ids in zip(fresh, self.table.merge(fresh), strict=True):
                self.words[w] = ids.astype("<i4").tobytes()
                self.held += len(w) + 4 * len(ids)
        known = self.words
        for u, ws in zip(units, split, strict=True):
            self.units[u] = b"".join([known[w] for w in ws])
            self.held += len(u) + len(self.units[u])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = self.table.cut
        pieces = [cut.split(t) if cut is not None and "<|" in t else [t] for t in texts]
        split = [[p if i % 2 else [u for u in SPACES.split(p) if u] if CONTROLS.search(p) else p.split() for i, p in enumerate(ps)] for ps in pieces]
        if max(len(self.units), len(self.words)) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.units.clear()
            self.words.clear()
            self.held = 0
        missing = list({u for ps in split for p in ps if isinstance(p, list) for u in p if u not in self.units})
        if missing:
            self._learn(missing)
        known, special = self.units, self.table.special
        return [b"".join([b"".join([known[u] for u in p]) if isinstance(p, list) else special[p].to_bytes(4, "little") for p in ps]) for ps in split]


def ids_array(blobs: list[bytes]) -> pa.ListArray:
    offs = np.zeros(len(blobs) + 1, dtype=np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))


def decode_ids(ids: pa.ListArray, table: MergeTable) -> pa.Array:
    """The tokens of each list joined by a space: what a tokenizer without a decoder gives."""
    flat = ids.values
    tokens = pa.ListArray.from_arrays(ids.offsets, table.names.take(flat))
    return pc.binary_join(tokens, " ")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df without ``text``, with the ids of its texts and, if named, the text decoded from them again.

    Null and empty texts have no ids and decode to the empty text.  Special tokens in a text are found as such.  Columns of df with
    the new names are replaced; an empty table gives no rows.
    """
    rest = [c for c in df.columns if c not in (text, ids, decoded)]
    df = df.select(*rest, text)
    schema = with_fields(df.select(*rest), (ids, "array<int>"), *([(decoded, "string")] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        encoder = Encoder(table)
        for batch in batches:
            col = batch.column(text)
            for a, b, _, _ in text_slices(col):
                got = ids_array(encoder.encode([t or "" for t in col.slice(a, b - a).to_pylist()]))
                cols = [batch.column(c).slice(a, b - a) for c in rest] + [got]
                if decoded:
                    cols.append(decode_ids(got, table))
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, ids, *([decoded] if decoded else [])])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of its ids; a null list decodes to the empty text.  A column of df with the new name is replaced."""
    df = df.drop(decoded) if decoded != ids else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for batch in batches:
            lists = [np.asarray(x if x is not None else [], dtype="<i4").tobytes() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_ids(ids_array(lists), table)], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, with_fields(df, (decoded, "string")))
