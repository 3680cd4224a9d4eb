"""The evidence filter and the fitting loop of the toxicity model against plain Python."""

import math
import random

import numpy as np

from parity.llm import toxicity as X


def statistic(bad, good, all_bad, all_good):
    """Twice the log-likelihood ratio of a two-by-two table."""
    total, out = all_bad + all_good, 0.0
    for seen, row, col in ((bad, bad + good, all_bad), (good, bad + good, all_good), (all_bad - bad, total - bad - good, all_bad), (all_good - good, total - bad - good, all_good)):
        if seen:
            out += 2 * seen * math.log(seen / (row * col / total))
    return out


def plain_fit(y, docs):
    """docs: lists of sentences, each a list of features."""
    n_bad = sum(y)
    held = [{f for s in d for f in s} for d in docs]
    counts = {f: (sum(f in h and t for h, t in zip(held, y, strict=True)), sum(f in h and not t for h, t in zip(held, y, strict=True))) for f in set().union(*held)}
    lift = {f: math.log((b + 0.5) / (n_bad + 1)) - math.log((g + 0.5) / (len(y) - n_bad + 1)) for f, (b, g) in counts.items() if statistic(b, g, n_bad, len(y) - n_bad) >= X.EVIDENCE}
    w, rate = dict.fromkeys(lift, 0.5), n_bad / len(y)
    sentences = sum(map(len, docs))
    bias = math.log(rate / max(1.0, sentences / len(y)) * 0.1)
    m, v, mb, vb = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0), 0.0, 0.0
    for t in range(1, X.ROUNDS + 1):
        gw, gb = {f: X.DECAY * w[f] for f in w}, 0.0
        for d, label in zip(docs, y, strict=True):
            p = [1 / (1 + math.exp(-max(-30, min(30, bias + sum(w[f] * lift[f] for f in s if f in w))))) for s in d]
            whole = min(max(1 - math.prod(1 - min(q, 1 - 1e-9) for q in p), 1e-9), 1 - 1e-9)
            for s, q in zip(d, p, strict=True):
                slope = (-q * (1 - whole) / whole if label else q) / len(y)
                gb += slope
                for f in s:
                    if f in w:
                        gw[f] += slope * lift[f]
        for f in w:
            m[f], v[f] = 0.9 * m[f] + 0.1 * gw[f], 0.999 * v[f] + 0.001 * gw[f] ** 2
            w[f] -= X.RATE * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.999**t)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        bias = max(bias - X.RATE * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8), X.LEAST_BIAS)
    return {f: w[f] * lift[f] for f in w}, bias


def test_fitting():
    rng = random.Random(8)
    docs, y = [], []
    for i in range(50):
        d = [sorted(rng.sample(range(20, 60), 4)) for _ in range(rng.randrange(1, 4))]
        if i % 3 == 0:
            d[0] = sorted({*d[0], rng.randrange(3)})
        y.append(int(i % 3 == 0))
        docs.append(d)
    features = [np.array([f for s in d for f in s], dtype=np.int32) for d in docs]
    sizes = [np.array([len(s) for s in d], dtype=np.int32) for d in docs]
    model = X.fit_bags(np.array(y, dtype=float), features, sizes)
    weights, bias = plain_fit(y, docs)
    assert weights and set(np.flatnonzero(model.weights)) == set(weights)
    assert np.allclose([model.weights[f] for f in weights], list(weights.values()), rtol=1e-6) and math.isclose(model.bias, bias, rel_tol=1e-6)
