"""Operators without SQL against slow versions in plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from parity.llm import common, fingerprints, secrets, toxicity, urls
from parity.llm.queries import QUERIES, URL_RULES

FULL = (1 << 64) - 1
TINY = "/root/testdata/sf0.001"


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def rolled(digits, base):
    total = 0
    for d in reversed(digits):
        total = (total * base + d) & FULL
    return mix(total)


# op1


def plain_names(data: bytes) -> list[int]:
    """Phrase names of one text, symbol by symbol."""
    sym, names = [mix(b + 1) for b in data], []
    if not data:
        return names
    for k in range(fingerprints.LEVEL):
        worth, short = 3 ** (fingerprints.LEVEL - k), []
        for s, run in groupby(sym):
            n = len(list(run))
            if n >= 2 * worth:
                names += [mix((s + 0x9FB21C651E98DF25) & FULL)] * (n // worth)
            short.append(mix((s + 0x632BE59BD9B4E019 * n) & FULL) if n > 1 else s)
        label = short
        for _ in range(fingerprints.TOSSES):
            tossed = []
            for x, y in zip(label, [label[0] ^ FULL, *label[:-1]], strict=True):
                bit = next((i for i in range(64) if (x ^ y) >> i & 1), 64)
                tossed.append(2 * bit + (x >> bit & 1))
            label = tossed
        n = len(label)
        starts = [i for i in range(n) if i == 0 or (i + 1 < n and label[i - 1] < label[i] >= label[i + 1])]
        sym = [(rolled(short[a:b], int(common.WORD_POWERS.base)) + k) & FULL for a, b in zip(starts, [*starts[1:], n], strict=True)]
    return names + sym


def plain_sketch(text: str) -> list[int]:
    kept = set()
    for name, many in Counter(plain_names(text.encode())).items():
        kept |= {(mix((name + 0x2545F4914F6CDD1D * i) & FULL) if i else name) >> 32 for i in range(many)}
    return sorted(kept)[: fingerprints.SKETCH]


def plain_likeness(a: list[int], b: list[int]) -> float:
    union = sorted({*a, *b})[: fingerprints.SKETCH]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def test_fingerprints_against_a_plain_parser(spark):
    rows = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in QUERIES["op1_fingerprints"](spark, TINY).collect()}
    assert set(got) == {r["doc_id"] for r in rows}
    hexed = lambda s: b"".join(x.to_bytes(4, "big") for x in s).hex()
    for one, two in list(zip(rows, [*rows[1:], rows[0]], strict=True))[:: max(1, len(rows) // 40)]:
        text, after = one["text"], two["text"]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        a, e, b = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        r = got[one["doc_id"]]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(a), hexed(e))
        assert (r["near_edited"], r["near_next"]) == (plain_likeness(a, e), plain_likeness(a, b))


def test_fingerprints_of_runs_against_a_plain_parser():
    texts = ["", "a", "aa", "ab" * 40, "=" * 300 + "x", "é" * 90, "one two three " * 9, "abcabcabd", "\x00\x00\x01"]
    assert [s.tolist() for s in fingerprints.of_texts(texts)] == [plain_sketch(t) for t in texts]


# op6


def plain_scores(text: str, model: toxicity.Model) -> tuple[float, list[float]]:
    """Noisy-or of a text and the scores of its sentences with words."""
    low = bytearray()
    for b in text.encode():
        accented = low and low[-1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97
        low.append(b + 32 if 65 <= b <= 90 or accented else b)
    odds = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    base, each = odds(model.bias), []
    for sentence in re.split(rb"[\n.!?]", bytes(low)):
        features = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence):
            digits = [b + 1 for b in w]
            names = [rolled(digits, int(common.BYTE_POWERS.base))]
            names += [(rolled(digits[:k], int(common.BYTE_POWERS.base)) + k) & FULL for k in toxicity.BEGINNINGS if len(w) > k]
            features |= {x >> (64 - toxicity.BITS) for x in names}
        if features:
            each.append(odds(sum(float(model.weights[f]) for f in features) + model.bias))
    clean = 1.0 - base if each else 1.0
    for p in each:
        clean *= min(1.0, (1 - min(p, 1 - 1e-9)) / (1 - base))
    return 1 - clean, each


def test_toxicity_scores_against_a_plain_noisy_or(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text")
    more = [(-1, None), (-2, ""), (-3, "... !"), (-4, "ÀÉÎ Über × straße. A1b2!\nvery VERY longwordhere? x")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    model = toxicity.fit(docs, spark.read.parquet(f"{TINY}/labels.parquet"))
    model = toxicity.Model(np.where(model.weights == 0, np.random.default_rng(3).normal(-1, 1, len(model.weights)), model.weights).astype(np.float32), model.bias)
    for r in toxicity.score(docs, model).collect():
        doc, each = plain_scores(r["text"] or "", model)
        assert r["score"] == pytest.approx(doc, abs=1e-6)
        assert [s["score"] for s in r["offending"]] == pytest.approx([p for p in each if p >= 0.3], abs=1e-6)


def test_toxicity_slopes_are_those_of_the_loss():
    """The slope by every sentence's log odds against a difference of the documents' cross-entropy."""
    rng = np.random.default_rng(4)
    document, y = np.array([0, 0, 1, 1, 1, 2, 3, 3]), np.array([1.0, 0.0, 1.0, 0.0])
    z = rng.normal(0, 1.5, len(document))

    def loss(z):
        clean = [math.prod(1 - 1 / (1 + math.exp(-x)) for x in z[document == d]) for d in range(len(y))]
        return -sum(math.log(1 - c) if t else math.log(c) for t, c in zip(y, clean, strict=True)) / len(y)

    got = toxicity._slopes(1 / (1 + np.exp(-z)), document, y)
    for i in range(len(z)):
        step = np.eye(len(z))[i] * 1e-5
        assert got[i] == pytest.approx((loss(z + step) - loss(z - step)) / 2e-5, abs=1e-7)


# op9


def plain_verdicts(texts: list[tuple[int, str, str | None]]) -> dict[int, str]:
    """Verdicts of (id, url, verdict of a rule or None), model and threshold counted gram by gram."""
    def classes(text):
        seq = []
        for b in text.encode():
            c = bytes([b]).lower()
            mark = urls.MARKS.find(c)
            seq.append(1 + c[0] - 97 if b"a" <= c <= b"z" else 27 if b"0" <= c <= b"9" else 28 + mark if mark >= 0 else urls.SYMBOLS - 1)
        padded = [0] * urls.ORDER + seq + [0]
        return [tuple(padded[i : i + urls.ORDER + 1]) for i in range(len(seq) + 1)]

    counts = {"allow": Counter(), "block": Counter()}
    held = []
    for _, text, rule in texts:
        if rule and zlib.crc32(text.encode()) % urls.CALIBRATION_FOLDS:
            counts[rule].update(classes(text))
        elif rule:
            held.append((text, rule))
    mean = (sum(counts["allow"].values()) + sum(counts["block"].values())) / 2
    followers, tails = defaultdict(set), {k: defaultdict(float) for k in counts}
    for kind, c in counts.items():
        share = mean / sum(c.values())
        for gram, n in c.items():
            for k in range(urls.ORDER + 1):
                tail = gram[urls.ORDER - k :]
                followers[tail[:-1]].add(tail[-1])
                tails[kind][tail] += n * share
                tails[kind][(tail[:-1], "all")] += n * share

    def log_prob(kind, gram):
        p = 1 / urls.SYMBOLS
        for k in range(urls.ORDER + 1):
            tail = gram[urls.ORDER - k :]
            kinds = len(followers[tail[:-1]])
            if kinds:
                p = (tails[kind][tail] + kinds * p) / (tails[kind][(tail[:-1], "all")] + kinds)
        return math.log(p)

    ratio = {}

    def score(text):
        for gram in classes(text):
            if gram not in ratio:
                ratio[gram] = float(np.float32(log_prob("allow", gram) - log_prob("block", gram)))
        return sum(map(ratio.get, classes(text))) / len(classes(text))

    bins = [(math.floor(max(-20.0, min(20.0, score(t))) / urls.BIN), rule) for t, rule in held]
    good, bad = [b for b, r in bins if r == "allow"], [b for b, r in bins if r == "block"]
    best = lambda c: sum(b >= c for b in good) / len(good) + sum(b < c for b in bad) / len(bad)
    cuts = sorted({0, *(b for b, _ in bins), *(b + 1 for b, _ in bins)})
    top = max(map(best, cuts))
    threshold = min((c for c in cuts if best(c) >= top - 1e-12), key=abs) * urls.BIN
    return {i: rule or ("allow" if score(t) >= threshold else "block") for i, t, rule in texts}


def test_urls_against_a_plain_model(spark):
    pages = [(r["page_id"], r["url"] or "") for r in spark.read.parquet(f"{TINY}/pages.parquet").select("page_id", "url").collect()]
    got = {r["page_id"]: r for r in QUERIES["op9_url_filter"](spark, TINY).collect()}
    texts = []
    for i, url in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        texts.append((i, url, max(fits)[1] if fits else None))
    free = sum(rule is None for _, _, rule in texts)
    assert {i: r["verdict"] for i, r in got.items()} == plain_verdicts(texts) and free > 10


# op4


def test_secrets_of_very_long_texts(spark):
    """One text of very many candidates, and one value of half a million marks of one and two code units: neither recursion nor copies."""
    draw = random.Random(8)
    values = ["".join(draw.choices("0123456789abcdef", k=40)) for _ in range(40_000)]
    many = " ".join(f'é token = "{v}"' if i % 2 else f"é {v[:20]}" for i, v in enumerate(values))
    wide = "password=" + "a😀" * 250_000
    df = spark.createDataFrame([(1, many), (2, wide), (3, ""), (4, None)], "doc_id long, text string")
    found = secrets.scan(df).collect()
    texts = {1: many, 2: wide}
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + len(r["value"])] == r["value"] for r in found)
    assert sorted(r["nth"] for r in found if r["doc_id"] == 1) == list(range(40_000))
    assert [r["start"] for r in found if r["doc_id"] == 2] == [9]
    gone = {(r["doc_id"], r["start"]): len(r["value"]) for r in found if r["secret"]}
    assert sum(i == 1 for i, _ in gone) > 15_000
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert (clean[3], clean[4]) == ("", None)
    for i, text in texts.items():
        parts, at = [], 0
        for start in sorted(s for d, s in gone if d == i):
            parts += [text[at:start], "[SECRET]"]
            at = start + gone[i, start]
        assert clean[i] == "".join(parts) + text[at:]
