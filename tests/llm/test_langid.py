"""The byte network against plain Python: states one cell at a time, slopes by differences, pooling; held-out accuracy and edges of the query's parts."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parity.llm import langid
from parity.llm.queries import QUERIES


def plain_states(codes, w, d):
    hidden = w[f"u{d}"].shape[1]
    state, out = [0.0] * hidden, {}
    sig = lambda v: 1 / (1 + math.exp(-v))
    for t in range(len(codes)) if d == "f" else reversed(range(len(codes))):
        held = [sum(float(w[f"u{d}"][r, k]) * state[k] for k in range(hidden)) for r in range(3 * hidden)]
        given = [float(w[f"w{d}"][r, codes[t]]) for r in range(3 * hidden)]
        new = []
        for k in range(hidden):
            z, r = sig(given[k] + held[k]), sig(given[hidden + k] + held[hidden + k])
            n = math.tanh(given[2 * hidden + k] + r * (held[2 * hidden + k] + float(w[f"b{d}"][k, 0])))
            new.append((1 - z) * n + z * state[k])
        state = out[t] = new
    return out


def plain_label(codes, w):
    f, b = plain_states(codes, w, "f"), plain_states(codes, w, "b")
    rows = []
    for t in range(len(codes)):
        z = [float(np.dot(w["vf"][k], f[t]) + np.dot(w["vb"][k], b[t]) + w["c"][k, 0]) for k in range(len(w["c"]))]
        e = [math.exp(v - max(z)) for v in z]
        rows.append([v / sum(e) for v in e])
    return rows


@pytest.fixture(scope="module")
def weights():
    w = langid.new_weights(3, 4, seed=2)
    return {k: a + np.float32(0.01) * (k[0] == "b") for k, a in w.items()}


def test_labels_against_plain(weights):
    x = np.random.default_rng(1).integers(0, 256, (5, 9)).astype(np.int16)
    x[1, 6:], x[2, 1:] = langid.PAD, langid.PAD
    p = langid.label(x, weights)[0].reshape(3, 9, 5)
    for i, row in enumerate(x):
        codes = [int(c) for c in row if c != langid.PAD]
        assert np.allclose(p[:, : len(codes), i].T, plain_label(codes, weights), atol=1e-5)


def test_slopes_against_differences(weights):
    rng = np.random.default_rng(4)
    w = {k: a.astype(np.float64) for k, a in weights.items()}
    x, y = rng.integers(0, 12, (6, 10)).astype(np.int16), rng.integers(0, 3, 6)
    x[3, 5:] = langid.PAD
    loss = lambda: langid.slopes(x, y, w)[0]
    _, g = langid.slopes(x, y, w)
    for k, a in w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in a.shape) if k[0] != "w" else (rng.integers(0, a.shape[0]), rng.integers(0, 12))
            old = a[at]
            a[at] = old + 1e-2
            up = loss()
            a[at] = old - 1e-2
            down = loss()
            a[at] = old
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-4, k


def test_pooled_is_the_mean_over_positions(weights):
    texts = ["", "a", "hello wörld " * 40, "x" * 64]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = langid._pooled(buf, offs, weights)
    for text, p in zip(texts, got, strict=True):
        raw = list(text.encode())
        rows = [r for i in range(0, len(raw), langid.WINDOW) for r in plain_label(raw[i : i + langid.WINDOW], weights)]
        assert np.allclose(p, np.mean(rows, axis=0) if rows else 0, atol=1e-5)


def test_query_on_held_out(spark, duck, sf_dir):
    want = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op12_language_id"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) >= 0.9


def test_edges(spark):
    known = [(i, ("der die und ist das nicht " if i % 2 else "the of and to in is was ") * 20, "de" if i % 2 else "en") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 ... 4", "de"), (103, "the and of " * 30_000, None), (None, "und der die das", "de"), (0, "the the the of and was", "en"), (104, "Ω", None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in known + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).filter("doc_id >= 1 or doc_id is null").collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en" and got[None][0] == "de" and got[104][0] in ("de", "en") and got[1][0] == "de" and got[2][0] == "en"
    runs = {r["doc_id"]: r["langs"] for r in langid.spans(df.filter("doc_id in (1, 100, 101, 104)"), model).collect()}
    assert not runs[100] and not runs[101] and runs[104][-1]["to"] == 2 and runs[1][0]["from"] == 0 and runs[1][-1]["to"] == 26 * 20
    none = df.limit(0)
    assert langid.fit(none) is None and langid.fit(df.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.predict(none, model).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(df, None).collect()} == {("und", 0.0)}
