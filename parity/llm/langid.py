"""Language of texts: a bidirectional gated recurrent network over bytes that labels every position.

Texts are cut into windows of 64 bytes, which run side by side: in each the network reads forwards and backwards, so that a position's label
sees the window on both sides.  A document's probabilities are the mean over its positions.  The network is trained in numpy by
backpropagation through time on a bounded sample of labelled windows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, with_fields

WINDOW = 64  # bytes that the network reads at a time
HIDDEN = 12  # cells in either direction
LANES = 2048  # windows side by side
PER_LANGUAGE = 300  # labelled documents of a language that are learned from, at most
PER_DOCUMENT = 4  # their windows, evenly spaced
MOST_LANGUAGES = 100  # the most frequent of them
EPOCHS, BATCH, RATE, SEED = 8, 256, 0.02, 11
PAD = 256
UNKNOWN = "und"

Weights = dict[str, np.ndarray]


@dataclass
class Model:
    languages: list[str]
    weights: Weights


def new_weights(languages: int, hidden: int = HIDDEN, seed: int = SEED) -> Weights:
    """w*: what a byte adds to the gates (update, reset, new), one column a byte; u*: what the state adds; b*: the state's bias in the new
    value; v*, c: the labels' weights.  The pad keeps the state as it is."""
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for d in "fb":
        w[f"w{d}"] = rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32)
        w[f"u{d}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        w[f"b{d}"] = np.zeros((hidden, 1), np.float32)
        w[f"v{d}"] = rng.normal(0, hidden**-0.5, (languages, hidden)).astype(np.float32)
        w[f"w{d}"][:, PAD] = 0
        w[f"w{d}"][:hidden, PAD] = 40
    w["c"] = np.zeros((languages, 1), np.float32)
    return w


def windows_of(buf: np.ndarray, offs: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The windows of texts (bytes, and the pad after a text's end) and the text of each."""
    many = -(-np.diff(offs) // width)
    text = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = (offs[:-1][text] + nth * width)[:, None] + np.arange(width)
    inside = at < offs[1:][text][:, None]
    out = np.full(at.shape, PAD, dtype=np.int16)
    out[inside] = buf[at[inside]]
    return out, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _direction(x: np.ndarray, w: Weights, d: str, keep: list | None = None) -> np.ndarray:
    """States (steps, hidden, lanes) of one direction; x: (steps, lanes).  ``keep`` gets what the way back needs."""
    table, u, b = w[f"w{d}"], w[f"u{d}"], w[f"b{d}"]
    steps, hidden = len(x), u.shape[1]
    out = np.empty((steps, hidden, x.shape[1]), np.float32)
    state = np.zeros(out.shape[1:], np.float32)
    for t in range(steps) if d == "f" else reversed(range(steps)):
        given, held = table.take(x[t], axis=1), u @ state
        gates = _sigmoid(given[: 2 * hidden] + held[: 2 * hidden])
        update, reset, past = gates[:hidden], gates[hidden:], held[2 * hidden :] + b
        new = np.tanh(given[2 * hidden :] + reset * past)
        if keep is not None:
            keep.append((t, state, update, reset, past, new))
        state = new + update * (state - new)
        out[t] = state
    return out


def label(x: np.ndarray, w: Weights, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities (labels, steps * lanes) of every position of windows x (lanes, steps), and the states of both directions."""
    x = np.ascontiguousarray(x.T)
    flat = lambda h: h.transpose(1, 0, 2).reshape(h.shape[1], -1)
    f, b = (flat(_direction(x, w, d, keep[i] if keep else None)) for i, d in enumerate("fb"))
    z = w["vf"] @ f + w["vb"] @ b + w["c"]
    z = np.exp(z - z.max(axis=0))
    return z / z.sum(axis=0), f, b


def slopes(x: np.ndarray, y: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Mean cross-entropy of all positions that are no pad, where window i has the label y[i], and its slope by every weight."""
    lanes, steps = x.shape
    keep: tuple[list, list] = ([], [])
    p, f, b = label(x, w, keep)
    inside = (x.T != PAD).reshape(-1).astype(np.float32)
    of, total = np.tile(y, steps), max(float(inside.sum()), 1.0)
    loss = float(-(np.log(np.maximum(p[of, np.arange(len(of))], 1e-30)) * inside).sum() / total)
    e = p.copy()
    e[of, np.arange(len(of))] -= 1
    e *= inside / np.float32(total)
    out: Weights = {"c": e.sum(axis=1, keepdims=True), "vf": e @ f.T, "vb": e @ b.T}
    for d, kept in zip("fb", keep, strict=True):
        u = w[f"u{d}"]
        hidden = u.shape[1]
        above = (w[f"v{d}"].T @ e).reshape(hidden, steps, lanes)
        du, db, table = np.zeros_like(u), np.zeros_like(w[f"b{d}"]), np.zeros_like(w[f"w{d}"])
        back = np.zeros((hidden, lanes), np.float32)
        for t, state, update, reset, past, new in reversed(kept):
            back = back + above[:, t]
            d_new = back * (1 - update) * (1 - new * new)
            d_update = back * (state - new) * update * (1 - update)
            d_reset = d_new * past * reset * (1 - reset)
            d_past = d_new * reset
            d_held = np.concatenate([d_update, d_reset, d_past])
            d_given = np.concatenate([d_update, d_reset, d_new])
            du += d_held @ state.T
            db += d_past.sum(axis=1, keepdims=True)
            one = np.zeros((lanes, 257), np.float32)
            one[np.arange(lanes), x[:, t]] = 1
            table += d_given @ one
            back = back * update + u.T @ d_held
        table[:, PAD] = 0
        out |= {f"u{d}": du, f"b{d}": db, f"w{d}": table}
    return loss, out


def train(x: np.ndarray, y: np.ndarray, languages: int) -> Weights:
    """Weights by Adam over shuffled batches, each language of equal weight whatever its number of windows."""
    w, rng = new_weights(languages), np.random.default_rng(SEED)
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    share = 1.0 / np.bincount(y, minlength=languages)[y]
    size, t = max(1, -(-len(y) // BATCH)), 0
    for epoch in range(EPOCHS):
        for _ in range(size):
            t += 1
            pick = rng.choice(len(y), min(BATCH, len(y)), p=share / share.sum())
            _, g = slopes(x[pick], y[pick], w)
            rate = RATE * (1 - epoch / EPOCHS) ** 0.5
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
    return w


def fit(docs: DataFrame) -> Model | None:
    """docs: (doc_id, text, lang), the rows to learn from.  Rows without lang, doc_id or text are left out; without any there is no model.

    Learned from: at most 300 documents of each of the 100 most frequent languages, the first by a hash of the id, and 4 windows of each,
    evenly spaced over the text.  The ids are drawn first, so that no text is shuffled; the bounded sample is one task's work.
    """
    known = docs.filter("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang", "text")
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    pairs = known.select("doc_id", "lang").join(F.broadcast(common.select("lang")), "lang")
    pairs = pairs.withColumn("nth", F.expr("row_number() over (partition by lang order by xxhash64(doc_id), doc_id)")).filter(F.col("nth") <= PER_LANGUAGE).select("doc_id", "lang").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in text_slices(batch.column("text")):
                x, of = windows_of(buf, offs)
                first, many = np.searchsorted(of, np.arange(b - a)), np.bincount(of, minlength=b - a)
                pick = [first[i] + np.unique(np.linspace(0, many[i] - 1, min(PER_DOCUMENT, many[i])).astype(int)) for i in range(b - a) if many[i]]
                pick = np.concatenate(pick) if pick else np.zeros(0, np.int64)
                lang = batch.column("lang").take(pa.array(a + of[pick]))
                yield pa.RecordBatch.from_arrays([lang, pa.array([r.astype("<i2").tobytes() for r in x[pick]], pa.binary())], names=["lang", "bytes"])

    rows = known.join(F.broadcast(pairs), ["doc_id", "lang"]).select("lang", "text").mapInArrow(cut, "lang string, bytes binary")
    rows = rows.orderBy(F.xxhash64("bytes"), "bytes", "lang").limit(MOST_LANGUAGES * PER_LANGUAGE * PER_DOCUMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = [], []
        for batch in batches:
            lang += batch.column("lang").to_pylist()
            held += batch.column("bytes").to_pylist()
        if held:
            names, y = np.unique(np.array(lang, dtype=object), return_inverse=True)
            w = train(np.frombuffer(b"".join(held), "<i2").reshape(-1, WINDOW), y, len(names))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((list(names), w))], pa.binary())], names=["model"])

    got = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return Model(*pickle.loads(got["model"])) if got else None


def _pooled(buf: np.ndarray, offs: np.ndarray, w: Weights) -> np.ndarray:
    """Mean probabilities (texts, labels) over a text's positions."""
    x, of = windows_of(buf, offs)
    many, labels = len(offs) - 1, len(w["c"])
    out = np.zeros((many, labels))
    for i in range(0, len(x), LANES):
        part, text = x[i : i + LANES], of[i : i + LANES]
        p = label(part, w)[0].reshape(labels, WINDOW, -1)
        sums = (p * (part.T != PAD)).sum(axis=1, dtype=np.float64)
        for k in range(labels):
            out[:, k] += np.bincount(text, weights=sums[k], minlength=many)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (text, ...) with lang_pred and score, the pooled probability of that language; equal probabilities: the first by name.

    A text that is null, empty or without letters is ``und`` with score 0, as is every text where there is no model.  Columns of docs with the new
    names are replaced; repeated rows are predicted alike.
    """
    docs = docs.drop("lang_pred", "score")
    none = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")]
    if model is None:
        return docs.select("*", *none)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.languages, pa.string())
        for batch in batches:
            for a, b, buf, offs in text_slices(batch.column("text")):
                p = _pooled(buf, offs, m.weights)
                best = p.argmax(axis=1)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, names.take(pa.array(best)), pa.array(np.round(p[np.arange(b - a), best], 6))], names=[*part.schema.names, "lang_pred", "score"])

    done = docs.mapInArrow(run, with_fields(docs, ("lang_pred", "string"), ("score", "double")))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return done.select(*docs.columns, F.when(letters, F.col("lang_pred")).otherwise(none[0]).alias("lang_pred"), F.when(letters, F.least(F.col("score"), F.lit(1.0))).otherwise(none[1]).alias("score"))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``langs``, the runs of bytes of the text with one label: array of (from, to, lang).  Null and empty texts have none."""
    docs = docs.drop("langs")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.languages, pa.string())
        for batch in batches:
            for a, b, buf, offs in text_slices(batch.column("text")):
                x, of = windows_of(buf, offs)
                best = [label(x[i : i + LANES], m.weights)[0].argmax(axis=0).reshape(WINDOW, -1).T[x[i : i + LANES] != PAD] for i in range(0, len(x), LANES)]
                best = np.concatenate(best) if best else np.zeros(0, np.int64)
                edge = np.zeros(len(best) + 1, dtype=bool)
                edge[offs] = True
                edge[1:-1] |= best[1:] != best[:-1]
                cuts = np.flatnonzero(edge)
                starts, stops = cuts[:-1], cuts[1:]
                text = np.searchsorted(offs, starts, side="right") - 1
                runs = pa.StructArray.from_arrays([pa.array((starts - offs[text]).astype(np.int32)), pa.array((stops - offs[text]).astype(np.int32)), names.take(pa.array(best[starts]))], names=["from", "to", "lang"])
                part = batch.slice(a, b - a)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "langs"])

    return docs.mapInArrow(run, with_fields(docs, ("langs", "array<struct<from:int,to:int,lang:string>>")))
