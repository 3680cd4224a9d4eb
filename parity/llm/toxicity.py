"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of its distinct hashed features (whole words and word beginnings); a
document's is the noisy-or of its sentences', so that training on document labels alone finds the offending ones.
When documents are scored, the base rate (a sentence's score without any weighted feature) enters once for each document,
and a sentence only by what it holds beyond that: length alone is no evidence.
Only the text is an input.  The classifier is fitted on at most ``most`` labelled rows, drawn by a hash of
their id; every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_POWERS, LOWER, span_hash, text_slices, with_fields

BITS = 18  # features are hashed into 2^18 weights: 1 MB when broadcast
BEGINNINGS = (3, 4, 5)  # bytes of a longer word's beginning
MOST_LABELLED = 6000
EVIDENCE = 12.0  # a feature whose likelihood ratio against the labels is lower gets no weight
ROUNDS, RATE, DECAY = 200, 0.05, 1e-4
LEAST_BIAS = -10.5  # a plain sentence's log odds; lower would let a single mark of toxicity in a short text go unseen

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
STOP = np.zeros(256, dtype=bool)
STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Bags:
    """Features of many sentences, and the sentences of many documents."""

    feature: np.ndarray  # distinct within a sentence
    sentence: np.ndarray  # of each feature
    document: np.ndarray  # of each sentence
    start: np.ndarray  # bytes from the document's start
    stop: np.ndarray


def bags(buf: np.ndarray, offs: np.ndarray) -> Bags:
    """Sentences end at . ! ? or a line end, and with their document; a sentence without words counts for nothing."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Bags(none, none, none, none, none)
    low = LOWER[buf]
    capital = np.append(False, (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97))  # Latin letters with accents
    low[capital] += 32
    inside = WORD[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    digits = low.astype(np.uint64) + np.uint64(1)
    number = np.cumsum(STOP[low] | edge[:-1])[starts] if len(starts) else starts
    hashes, owner = [span_hash(digits, starts, ends, BYTE_POWERS)], [number]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts > k)
        hashes.append(span_hash(digits, starts[long], starts[long] + k, BYTE_POWERS) + np.uint64(k))
        owner.append(number[long])
    feature = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(np.concatenate(owner) << BITS | feature)
    first = np.flatnonzero(np.diff(number, prepend=-1)) if len(number) else number
    last = np.append(first[1:], len(number)) - 1 if len(first) else first
    kinds = number[first]
    document = np.searchsorted(offs, starts[first], side="right") - 1
    return Bags(both & ((1 << BITS) - 1), np.searchsorted(kinds, both >> BITS), document, starts[first] - offs[document], ends[last] - offs[document])


def _sentence_scores(feature: np.ndarray, sentence: np.ndarray, many: int, weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.bincount(sentence, weights=weights[feature], minlength=many) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _clean_log(p: np.ndarray, document: np.ndarray, many: int) -> np.ndarray:
    """log of the noisy-or's complement for each document."""
    return np.bincount(document, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=many)


def _document_scores(p: np.ndarray, document: np.ndarray, many: int, bias: float) -> np.ndarray:
    """Noisy-or of the base rate, once for each document with a sentence, and of what its sentences hold beyond it."""
    base = np.log1p(-min(1.0 / (1.0 + np.exp(-np.clip(bias, -30, 30))), 1 - 1e-9))
    beyond = np.minimum(np.log1p(-np.minimum(p, 1 - 1e-9)) - base, 0.0)
    some = np.bincount(document, minlength=many) > 0
    return -np.expm1(np.bincount(document, weights=beyond, minlength=many) + np.where(some, base, 0.0)) + 0.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """docs: (doc_id, text), labels: (doc_id, toxic 0/1).  Null labels are left out; without both labels every score is the base rate.

    The sample is drawn from the labels, so that it is small enough to broadcast (``most`` rows) and no text is shuffled.
    """
    chosen = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").limit(most).select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, features, sizes = [], [], []
        for batch in batches:
            y += batch.column("toxic").to_pylist()
            for a, b, buf, offs in text_slices(batch.column("text")):
                g = bags(buf, offs)
                many = np.bincount(g.sentence, minlength=len(g.document)).astype(np.int32)
                sents = np.searchsorted(g.document, np.arange(b - a + 1))
                ends = np.concatenate([[0], np.cumsum(many)])[sents]
                feats = g.feature.astype(np.int32)
                features += [feats[ends[i] : ends[i + 1]].copy() for i in range(b - a)]
                sizes += [many[sents[i] : sents[i + 1]].copy() for i in range(b - a)]
        model = fit_bags(np.array(y, dtype=np.float64), features, sizes)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    # the bounded sample is one task's work; only the weights (1 MB) come back
    got = rows.coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(got["weights"], dtype="<f4"), got["bias"]) if got else fit_bags(np.zeros(0), [], [])


def _evidence(bad: np.ndarray, good: np.ndarray, all_bad: float, all_good: float) -> np.ndarray:
    """Likelihood ratio statistic of each feature's two-by-two table of documents."""
    with_f, total = bad + good, all_bad + all_good
    cells = [(bad, with_f * all_bad / total), (good, with_f * all_good / total), (all_bad - bad, (total - with_f) * all_bad / total), (all_good - good, (total - with_f) * all_good / total)]
    return 2 * sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9)), 0.0) for seen, due in cells)


def _slopes(p: np.ndarray, document: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope of the documents' mean cross-entropy by each sentence's log odds: p for a clean document's sentence, and -p for a toxic
    one's, scaled by (1 - doc) / doc."""
    doc = np.clip(-np.expm1(_clean_log(p, document, len(y))), 1e-9, 1 - 1e-9)
    return np.where(y[document] > 0, -p * ((1 - doc) / doc)[document], p) / len(y)


def fit_bags(y: np.ndarray, features: list[np.ndarray], sizes: list[np.ndarray]) -> Model:
    """features: of all sentences of a document; sizes: how many belong to each of its sentences."""
    weights = np.zeros(1 << BITS)
    rate = float(y.mean()) if len(y) else 0.0
    sentences = sum(map(len, sizes))
    if not 0 < rate < 1 or not sentences:
        return Model(weights, float(np.log((rate + 1e-3) / (1 - rate + 1e-3)) if len(y) else -6.0))
    counts = np.zeros((2, 1 << BITS))
    for label, f in zip(y, features, strict=True):
        counts[int(label), np.unique(f)] += 1
    good, bad = counts
    lift = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / (len(y) - y.sum() + 1))
    use = _evidence(bad, good, float(y.sum()), float(len(y) - y.sum())) >= EVIDENCE
    document = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    kept, of, base = [], [], 0
    for f, s in zip(features, sizes, strict=True):
        at = use[f]
        kept.append(f[at])
        of.append((np.repeat(np.arange(len(s)), s) + base)[at])
        base += len(s)
    kinds, feature = np.unique(np.concatenate(kept), return_inverse=True)
    sentence = np.concatenate(of)
    scale = lift[kinds]  # a weight is a share of its feature's log odds
    w, bias = np.full(len(kinds), 0.5), float(np.log(rate / max(1.0, sentences / len(y)) * 0.1))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        p = _sentence_scores(feature, sentence, sentences, w * scale, bias)
        slope = _slopes(p, document, y)
        gw = scale * np.bincount(feature, weights=slope[sentence], minlength=len(kinds)) + DECAY * w
        gb = float(slope.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias = max(bias - RATE * (mb / a) / (np.sqrt(vb / b) + 1e-8), LEAST_BIAS)
    weights[kinds] = w * scale
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, cut: float = 0.3, name: str = "score", spans_name: str = "offending") -> DataFrame:
    """docs with a score (0 to 1) and the byte spans and scores of the sentences at or above ``cut``.

    The null or empty text has no sentence and the score 0; repeated rows score alike.  Columns of docs with the new names are replaced.
    """
    docs = docs.drop(name, spans_name)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    schema = with_fields(docs, (name, "double"), (spans_name, "array<struct<from:int,to:int,score:double>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for a, b, buf, offs in text_slices(batch.column("text")):
                g = bags(buf, offs)
                p = _sentence_scores(g.feature, g.sentence, len(g.document), weights, bias)
                doc = _document_scores(p, g.document, b - a, bias)
                bad = np.flatnonzero(p >= cut)
                spans = pa.StructArray.from_arrays([pa.array(g.start[bad].astype(np.int32)), pa.array(g.stop[bad].astype(np.int32)), pa.array(p[bad])], names=["from", "to", "score"])
                at = np.searchsorted(g.document[bad], np.arange(b - a + 1)).astype(np.int32)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(doc, 0.0, 1.0)), pa.ListArray.from_arrays(pa.array(at), spans)], names=[*part.schema.names, name, spans_name])

    return docs.mapInArrow(run, schema)
