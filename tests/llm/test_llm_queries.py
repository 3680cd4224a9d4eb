"""The registered queries of parity.llm against SQL or a brute-force version in plain Python."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import same_rows
from tokenizers import Tokenizer

from parity.llm.queries import ORACLES, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_op1(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op1_fingerprints"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(text)
        assert rows[i]["n_chars"] == n
        assert rows[i]["edited_sha256"] == digest(text[: n - n // 4] + after[: n // 4])
        assert prints.setdefault(text, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    near = [rows[i]["near_edited"] for i, text in docs if len(text) > 400]
    assert np.mean(near) > 0.5 and min(near) > 0.1
    assert np.mean([r["near_next"] for r in rows.values()]) < 0.05


def test_op2(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(text, add_special_tokens=False).ids + [1] for i, text in docs}
    rows = QUERIES["op2_packing"](spark, sf_dir).collect()
    covered, sequences = {i: np.zeros(len(x), int) for i, x in ids.items()}, {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((c == 1).all() for c in covered.values())
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.03 * sum(map(len, ids.values()))


def test_op4(spark, sf_dir, docs):
    rows = QUERIES["op4_secret_scan"](spark, sf_dir).collect()
    texts = dict(docs)
    for r in rows:
        assert digest(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["value_sha256"]
    want = {(i, m.start(1)) for i, text in docs for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)}
    assert {(r["doc_id"], r["start"]) for r in rows if r["secret"]} >= want


def test_op6(spark, duck):
    """Held-out labels of a larger table, where there are enough to learn from."""
    rows = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()
    labels = dict(duck.execute("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [r for r in held if labels[r["doc_id"]]], [r for r in held if not labels[r["doc_id"]]]
    assert sum(r["predicted"] for r in toxic) > 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) < 0.02 * len(clean)


def test_op7(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op7_bpe"](spark, sf_dir).collect()}
    for i, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == digest(" ".join(map(str, ids)))
        assert rows[i]["decoded_sha256"] == digest(t.decode(ids, skip_special_tokens=False))


def test_op8(spark, sf_dir, docs):
    from collections import Counter

    words = [(i, WORDS.findall(text)) for i, text in docs]
    seen = Counter(tuple(w[j : j + 35]) for _, w in words for j in range(len(w) - 34))
    rows = {r["doc_id"]: r for r in QUERIES["op8_substring_dedup"](spark, sf_dir).collect()}
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (len(w), gone.sum(), digest(kept))


def test_op9(spark, sf_dir, duck):
    rows = {r["page_id"]: r for r in QUERIES["op9_url_filter"](spark, sf_dir).collect()}
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    pages = duck.execute("SELECT page_id, url FROM pages").fetchall()
    assert len(rows) == len(pages)
    for i, url in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit[1] if fit else None)
        assert r["verdict"] == fit[2] if fit else r["verdict"] in ("allow", "block")


def test_pipeline(spark, sf_dir, docs):
    """The pipeline against its stages in plain Python, from the toxicity scores and secrets on."""
    import corpus_pipeline as P

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = P.drop_toxic(spark, documents, sf_dir)
    assert kept.columns == documents.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    sets = {}
    for i, text in texts.items():
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    of = {i: i for i in sets}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((top(a), top(b)))
                of[hi] = lo
    alone = P.drop_near_copies(spark, kept, sf_dir)
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(i for i in ids if top(i) == i)
    cut = P.cut_repeats(spark, alone, sf_dir)
    clean = P.redact_secrets(spark, cut, sf_dir)
    assert clean.columns == documents.columns
    final = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    assert not any(re.search(r'(?i)token = "[0-9a-f]{40}"', t) for t in final.values())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = P.run(spark, sf_dir).collect()
    tokens = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in final.items()}
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == tokens
