"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import json
import random
import re
import string
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parity.llm import bpe, chat, fingerprints, jaccard, packing, secrets, substrings, topk, toxicity, urls
from parity.llm.common import components

random.seed(3)
VOCAB = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(800)]
LONG = " ".join(random.choices(VOCAB, k=60_000))
PASSAGE = " ".join(random.choices(VOCAB, k=80))
ROWS = [
    (0, None), (1, ""), (2, "   \n\t"), (3, "one two"), (4, "ONE two"), (5, LONG), (6, LONG + " tail"), (7, "same text again and again here"), (8, "same text again and again here"),
    (9, PASSAGE + " a b c"), (10, "x y z " + PASSAGE), (11, "z" * 5000), (12, "la " * 3000), (None, "no id"), (14, "é" * 10 + " Σ ς " + "日本語"), (15, "<|endoftext|> <|startoftext|>"),
]
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df, col):
    return {r["doc_id"]: r[col] for r in df.collect()}


def test_fingerprints(docs, none):
    got = fingerprints.edited_and_next(docs).collect()
    assert len(got) == len(ROWS)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[0] == prints[1] == "" and prints[7] == prints[8]
    near = {r["doc_id"]: r["near_next"] for r in got}
    assert near[0] == 1 and near[5] > 0.9 and near[7] == 1 and near[3] < 1
    assert fingerprints.edited_and_next(none).count() == 0
    again = fingerprints.fingerprint(docs.withColumn("fingerprint", F.lit("old"))).select("doc_id", "fingerprint")
    assert by_id(again, "fingerprint") == prints


def test_equal_substrings_share_phrases():
    shift = [fingerprints.of_texts([("q" * k) + " " + LONG])[0] for k in (0, 1, 7)]
    assert all(fingerprints.sketch_likeness(shift[0], s) > 0.95 for s in shift)
    names = [set(fingerprints.parse(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist()) for t in (PASSAGE, "other start " + PASSAGE)]
    assert len(names[0] & names[1]) > 0.6 * len(names[0])


def test_packing(docs, none):
    rows = packing.pack(docs, BYTE).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_id"] in (0, 1)) == 2
    lib = Tokenizer.from_file(BYTE)
    for i, text in ROWS:
        got = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]))
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(text or "", add_special_tokens=False).ids + [1]
    assert packing.pack(none, BYTE).count() == 0
    assert packing.pack(docs.unionAll(docs), BYTE, keep_ids=False).count() == 2 * len(rows)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    hist = np.bincount(rng.integers(1, 2049, 5000), minlength=2049)
    used = np.zeros_like(hist)
    for lengths, n in packing.plan(hist, 2048):
        assert sum(lengths) <= 2048
        np.add.at(used, list(lengths), n)
    assert (used == hist).all()


def test_jaccard(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs.withColumn("n", F.lit(1))).collect()}
    assert len(got) == len(ROWS)
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2)
    assert got[3] == got[4] == (1, 3) and got[6][1] == 5 and got[8][1] == 7 and got[9][1] == 9 and got[10][1] == 9
    assert got[12] == (1, 12)
    assert jaccard.jaccard_join(none).count() == 0


def test_jaccard_against_all_pairs(spark):
    """A large family of near copies and a passage that many unrelated texts share: blocks beyond the small size."""
    rng = random.Random(5)
    base = rng.choices(VOCAB, k=120)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, PASSAGE + " " + " ".join(rng.choices(VOCAB, k=rng.randint(5, 60)))) for i in range(60)]
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for i, t in rows}
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if of[a] > of[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    of[a], changed = of[b], True
    got = by_id(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")), "component_id")
    assert got == of


def test_jaccard_of_short_texts_at_the_threshold(spark):
    """Sets of 6 to 100 shingles and their parts just at and above 0.75: no link may be lost to the bound."""
    draw, rows, linked = random.Random(11), [], {}
    for i in range(3000):
        n = draw.randint(6, 100)
        words = [f"w{draw.getrandbits(40):x}" for _ in range(n + 4)]
        part = min(n, -(-3 * n // 4) + draw.choice([-1, 0, 0, 0, 1, 2]))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: part + 4]))]
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, words[: part + 4]))
        linked[2 * i + 1] = 2 * i if 100 * len(a & b) >= 75 * len(a | b) else 2 * i + 1
    got = by_id(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")), "component_id")
    assert {i: got[i] for i in linked} == linked
    assert all(got[2 * i] == 2 * i for i in range(3000))


def test_jaccard_over_many_leaves(monkeypatch, spark):
    """Families of more leaves than one: chains of edits, near copies and unrelated texts with a passage in common."""
    monkeypatch.setattr(jaccard, "LEAF_ROWS", 7)
    rng = random.Random(21)
    rows, w = [], rng.choices(VOCAB, k=90)
    for i in range(60):  # a chain: neighbours link, its ends do not
        w = [x if rng.random() > 0.012 else rng.choice(VOCAB) for x in w]
        rows.append((i, " ".join(w)))
    base = rng.choices(VOCAB, k=150)
    rows += [(100 + i, " ".join([*base[: 75 + i], *rng.choices(VOCAB, k=rng.randint(0, 25))])) for i in range(60)]
    rows += [(300 + i, PASSAGE + " " + " ".join(rng.choices(VOCAB, k=rng.randint(10, 40)))) for i in range(60)]
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for i, t in rows}
    of, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if of[a] > of[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    of[a], changed = of[b], True
    assert by_id(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")), "component_id") == of


def test_jaccard_of_many_texts_that_share_a_line(monkeypatch, spark):
    """A line in every text is put last and ties nothing together; links are those of all pairs, whichever shingles go last."""
    rng = np.random.default_rng(5)
    line, words = "this line is in every one of the texts", [f"w{i}" for i in range(5000)]
    texts = [f"{line} {' '.join(rng.choice(words, 40))}" for _ in range(600)]
    texts += [f"{t} more" for t in texts[::10]] + [f"{line} of {i}" for i in range(20)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    of = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                of = [of[i] if c == of[j] else c for c in of] if of[i] < of[j] else [of[j] if c == of[i] else c for c in of]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "OPEN_NODES", 64)
    seen = []
    monkeypatch.setattr(jaccard, "_leaf_pairs", lambda leaves, percent, f=jaccard._leaf_pairs: (seen.append(leaves), f(leaves, percent))[1])
    for least in (1 << 20, 64, 1):
        monkeypatch.setattr(jaccard, "COMMON_TEXTS", least)
        monkeypatch.setattr(jaccard, "COMMON_PART", 1)
        assert by_id(jaccard.jaccard_join(docs), "component_id") == dict(enumerate(of))
    assert seen[1].groupBy("family").count().agg(F.max("count")).first()[0] <= 40  # without the order, and with more nodes than are held open, hundreds


def test_a_pair_that_shares_one_small_block_is_no_family(monkeypatch, spark):
    """Long texts whose shingles all occur in some other text are parted by what a pair itself shares."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(5000)]
    one, two = (" ".join(rng.choice(words, 3000)) for _ in range(2))
    both = "these words are in both of them"
    rows = [(1, f"{one} {both}"), (2, f"{one} {both} end"), (3, f"{two} {both}"), (4, f"{two} {both} end")]
    seen = []
    monkeypatch.setattr(jaccard, "_leaf_pairs", lambda leaves, percent, f=jaccard._leaf_pairs: (seen.append(leaves), f(leaves, percent))[1])
    assert by_id(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")), "component_id") == {1: 1, 2: 1, 3: 3, 4: 3}
    assert sorted(r["count"] for r in seen[0].groupBy("family").count().collect()) == [2, 2]


def test_open_nodes_melt(monkeypatch):
    monkeypatch.setattr(jaccard, "OPEN_NODES", 3)
    boxes, rng = jaccard.Boxes(75), np.random.default_rng(2)
    edges = [e for i in range(30) for e in boxes.insert(i, 100, rng.multinomial(100, np.ones(1 + jaccard.GROUPS - jaccard.LOW) / 53).astype(np.int32))]
    assert len(boxes.members) <= 4 and edges


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in range(100, 140)} == {100} and 200 not in got


def test_secrets(docs, none, spark):
    assert secrets.scan(none).count() == 0
    found = secrets.scan(docs)
    assert {r["doc_id"] for r in found.collect()} <= {i for i, t in ROWS if t}
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"
    plain = [(i, f'{" ".join(random.choices(VOCAB, k=40))} superlongwordwithoutdigits{"x" * (i % 5)} end', 1) for i in range(40)]
    mine = plain + [(100 + i, f'some words token = "{key[i:] + key[:i]}" more', 2) for i in range(20)] + [(200, None, 3)]
    df = spark.createDataFrame(mine, "doc_id long, text string, k1 int")
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    texts = by_id(clean, "text")
    assert all("[SECRET]" in texts[100 + i] for i in range(20)) and all(texts[i] == t for i, t, _ in plain) and texts[200] is None


TOOLS = {"add": {"x": ("integer", True), "note": ("string", False)}}


def test_planted_findings_hold_out(spark, sf_dir):
    precision, recall = secrets.held_out_figures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert precision > 0.9 and recall > 0.9


def test_secrets_take_labelled_findings(spark):
    rows = [(i, f"the code is {'A' * 10}{i:010d} here") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(f"{'A' * 10}{i:010d}", "the code is ", " here", 1) for i in range(60)] + [(f"lowerletters{'q' * (i % 9)}", "x ", " y", 0) for i in range(60)], "value string, before string, after string, label int")
    assert secrets.scan(docs, labelled).filter("secret").count() == 40
    assert secrets.scan(docs, labelled.filter("label = 1")).count() == 40


def test_candidates_and_features_against_plain_python(spark, sf_dir):
    """Candidates by Python's re, the character features by counting."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, 'é api_key = "a1-b2 c3" x'), (-2, "tokens=ab&key=QQ w"), (-3, "a" * 16 + " " + "b" * 15), (-4, None), (-5, "pass: `x`")], "doc_id long, text string"))
    words = ["the", "and", "tion"]
    got = {(r["doc_id"], r["start"]): r for r in secrets.featured(secrets.candidates(docs), words).collect()}
    want = {}
    pattern, named = re.compile(secrets.CANDIDATE, re.A), re.compile(f"^({secrets.NAMED}[\"'`]?)(?=[^=])", re.A)
    for r in docs.collect():
        for m in pattern.finditer(r["text"] or ""):
            name = named.match(m.group())
            n = len(name.group(1)) if name else 0
            want[r["doc_id"], m.start() + n] = m.group()[n:]
    assert {k: r["value"] for k, r in got.items()} == want and len(want) > 20
    for r in got.values():
        v = r["value"]
        share = lambda keep: sum(c in keep for c in v) / len(v)  # noqa: B023, E731
        kind = ["0" if c in "0123456789" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "-" for c in v]
        expected = {
            "length": len(v), "digits": share("0123456789"), "uppers": share(string.ascii_uppercase), "lowers": share(string.ascii_lowercase), "vowels": share("aeiouAEIOU"),
            "turns": 1 - sum(a == b for a, b in zip(kind, kind[1:], strict=False)) / len(v), "kinds": len(set(v)) / min(len(v), 64), "covered": 1 - len(re.sub("tion|and|the", "", v.lower())) / len(v),
        }
        for name, x in expected.items():
            assert r[name] == pytest.approx(x), (name, v)


def test_secrets_of_every_form(spark):
    draw = random.Random(5)
    text = "".join
    b64, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    rows = [(i, f'some words api_key = "{text(draw.choices(b64, k=40))}" and words') for i in range(100)]
    rows += [(100 + i, f"see https://example.com/a/b/page{i}/{text(draw.choices(hexa, k=20))}/index for more words") for i in range(100)]
    slashed = text(draw.choices(b64, k=18)) + "q7/x2k" + text(draw.choices(b64, k=18))
    param, short = text(draw.choices(b64[:62], k=32)), "p4.s!w@9$k"
    rows += [(200, f'secret_key = "{slashed}"'), (201, f"https://host/and/or?my_api_key={param}&page=2"), (202, f"password={short} and p4 stays, and/or www.site.org/x"), (203, 'pwd: "x1 y2 z3"')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["value"]): r for r in secrets.scan(df).collect()}
    texts = dict(rows)
    assert all(texts[i][r["start"] : r["start"] + len(v)] == v for (i, v), r in got.items())
    assert got[200, slashed]["secret"] and got[201, param]["secret"] and got[202, short]["secret"] and (203, "x1 y2 z3") in got
    assert not any(r["secret"] for (i, _), r in got.items() if 100 <= i < 200)
    clean = by_id(secrets.redact(df), "text")
    assert clean[201] == "https://host/and/or?my_api_key=[SECRET]&page=2" and clean[202] == "password=[SECRET] and p4 stays, and/or www.site.org/x"
    alone = secrets.scan(df.filter("doc_id >= 200")).collect()
    assert {(r["doc_id"], r["value"]) for r in alone} >= {(200, slashed), (201, param), (202, short), (203, "x1 y2 z3")}


def test_chat(spark):
    call = lambda i, name, args, after="[]": f'{{"tool_call": {{"id": {i}, "name": "{name}", "arguments": {args}, "after": {after}}}}}'
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call('"a"', "add", '{"x": 1, "note": "n"}')), (1, 2, "tool", '{"tool_result": {"id": "a", "content": {"z": 1, "b": [1]}}}'),
        (1, 3, "assistant", call('"b"', "add", '{"x": "1", "y": 2}', '["a"]')), (1, 4, "assistant", call('"c"', "add", '{"x": 1}', '["d"]')), (1, 5, "assistant", call('"d"', "add", '{"x": 1}', '["c"]')),
        (1, 6, "assistant", call('"e"', "none", "{}")), (1, 7, "assistant", call('"f"', "add", '{"x": 2}', '["gone"]')), (1, 8, "assistant", call('"g"', "add", '{"x": 2}')),
        (1, 9, "assistant", call("null", "add", '{"x": 2}')), (2, 1, "assistant", None), (2, 2, None, "text"), (2, 3, "assistant", "{broken"), (None, None, "tool", '{"tool_result": {"id": "h", "content": 1}}'),
        (3, 5, "tool", '{"tool_result": {"id": "h", "content": "early"}}'), (3, 6, "assistant", call('"h"', "add", '{"x": 3}')), (3, 7, "assistant", call('"i"', "add", '{"x": 3}', '["h"]')), (3, 7, "assistant", call('"i"', "add", '{"x": 3}', '["h"]')),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(9))
    got = chat.link_tool_calls(df, TOOLS).collect()
    by = {r["call_id"]: r for r in got}
    assert {k: r["status"] for k, r in by.items()} == {
        "a": "ok", "b": "invalid arguments", "c": "cycle", "d": "cycle", "e": "unknown tool", "f": "missing predecessor", "g": "no result", None: "no id", "h": "result before call", "i": "no result",
    }
    assert by["a"]["record"] == '{"arguments":{"note":"n","x":1},"id":"a","name":"add","result":{"b":[1],"z":1}}'
    assert by["b"]["errors"] == "unexpected y; x is no integer" and by["b"]["level"] == 1 and by["i"]["level"] == 1
    assert sum(r["call_id"] == "i" for r in got) == 2
    assert chat.link_tool_calls(df.filter("false"), TOOLS).count() == 0


def test_chat_ids_count_within_a_conversation(spark):
    call = lambda i, after="[]": f'{{"tool_call": {{"id": "{i}", "name": "add", "arguments": {{"x": 1}}, "after": {after}}}}}'
    result = lambda i, content: f'{{"tool_result": {{"id": "{i}", "content": {content}}}}}'
    rows = [(1, 1, "assistant", call("call_1")), (1, 2, "tool", result("call_1", 10)), (2, 3, "assistant", call("call_1")), (2, 4, "tool", result("call_1", 20)), (2, 5, "assistant", call("b", '["call_1"]')), (3, 1, "assistant", call("b", '["call_1"]')), (None, 1, "assistant", call("call_1"))]
    got = {(r["conv_id"], r["call_id"]): (r["status"], r["level"], r["record"]) for r in chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert got[1, "call_1"][:2] == got[2, "call_1"][:2] == ("ok", 0) and '"result":10' in got[1, "call_1"][2] and '"result":20' in got[2, "call_1"][2]
    assert got[2, "b"][:2] == ("no result", 1) and got[3, "b"][0] == "missing predecessor" and got[None, "call_1"][:2] == ("no result", 0)


def test_chat_levels_against_a_plain_walk(spark):
    rng = random.Random(17)
    deps = {i: [i - 1] if i % 50 else [] for i in range(200)}  # chains of fifty
    deps |= {i: rng.sample(range(200, i), k=min(i - 200, rng.randint(0, 3))) + rng.sample(range(200), k=rng.randint(0, 1)) for i in range(200, 260)}
    deps |= {260: [261], 261: [262], 262: [260], 263: [262], 264: [263, 5], 265: [264], 266: [266], 267: [10, 11], 268: [267], 269: [268, 12]}
    calls = spark.createDataFrame([(str(i), [str(d) for d in ds]) for i, ds in deps.items()], "key string, deps array<string>")
    level = {}
    for _ in range(len(deps)):
        for i, ds in deps.items():
            if i not in level and all(d in level for d in ds):
                level[i] = max([level[d] + 1 for d in ds], default=0)
    assert {int(r["key"]): r["level"] for r in chat.levels(calls).collect()} == {i: level.get(i) for i in deps}


def test_chat_of_long_texts(spark):
    text = ("word \\n" + "é" * 10) * 20_000
    rows = [(1, 1, "assistant", json.dumps({"tool_call": {"id": "a", "name": "add", "arguments": {"x": 1, "note": text}}})), (1, 2, "tool", json.dumps({"tool_result": {"id": "a", "content": text}}))]
    got = chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()
    assert len(got) == 1 and json.loads(got[0]["record"]) == {"arguments": {"x": 1, "note": text}, "id": "a", "name": "add", "result": text}


def test_toxicity(docs, none, spark):
    rng = random.Random(4)
    rows = [(i, ". ".join(" ".join(rng.choices(VOCAB, k=8)) for _ in range(6)) + (". you vileword there" if i % 4 == 0 else "")) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels)
    held = toxicity.score(texts, model).filter("doc_id >= 200").collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in held)
    bad = next(r for r in held if r["doc_id"] == 200)
    assert b"vileword" in bad["text"].encode()[bad["offending"][0]["from"] : bad["offending"][0]["to"]]
    scores = toxicity.score(docs.withColumn("score", F.lit("x")), model)
    assert scores.count() == len(ROWS) and by_id(scores, "score")[0] == 0 == by_id(scores, "score")[1]
    assert toxicity.score(none, model).count() == 0
    one_kind = toxicity.fit(texts, labels.filter("toxic = 0"))
    assert toxicity.score(texts, one_kind).filter("score >= 0.3").count() == 0
    assert toxicity.score(texts, toxicity.fit(none, labels)).filter("score >= 0.3").count() == 0


def test_toxicity_is_no_matter_of_length(spark):
    rng = random.Random(8)
    plain = lambda n: "\n".join(" ".join(rng.choices(VOCAB, k=8)) for _ in range(n))
    texts = spark.createDataFrame([(i, plain(6) + (". you vileword there" if i % 4 == 0 else "")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    long = plain(20_000)
    kinds = spark.createDataFrame([(0, "one two three"), (1, long), (2, long + "\nyou vileword there"), (3, None), (4, "a line\n" * 20_000)], "doc_id long, text string")
    got = by_id(toxicity.score(kinds, toxicity.fit(texts, labels)), "score")
    assert max(got[0], got[1], got[4]) < 0.3 <= got[2] and got[3] == 0
    for few, rate in ((labels.filter("toxic = 0"), 0.001), (labels.filter("false"), 0.0025)):
        got = by_id(toxicity.score(kinds, toxicity.fit(texts, few)), "score")
        assert got[0] == got[1] == got[2] == got[4] == pytest.approx(rate, rel=0.05) and got[3] == 0


def test_bpe(docs, none):
    lib = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in bpe.encode(docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)), WORD, decoded="decoded").collect()}
    for i, text in ROWS:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, WORD).count() == 0
    back = bpe.decode(bpe.encode(docs, WORD).withColumn("decoded", F.lit("clash")), WORD)
    assert by_id(back, "decoded") == {i: r["decoded"] for i, r in got.items()}


def test_bpe_of_long_words():
    """The heap of a long word and the rounds of a short one give the library's ids."""
    table, lib, rng = bpe.table_of(WORD), Tokenizer.from_file(WORD), random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=n)) for n in (2, 3, 50, 900, 1500, 40_000)] + ["a" * 1025, "ab" * 600, "la" * 5000]
    for w in words:
        want = lib.encode(w).ids
        assert bpe.Encoder(table).encode([w])[0] == np.array(want, "<i4").tobytes()
        assert table.merge_long(w.encode()).tolist() == want
    assert [x.tolist() for x in table.merge([w.encode() for w in words])] == [lib.encode(w).ids for w in words]


def test_bpe_cache_may_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    table, lib = bpe.table_of(WORD), Tokenizer.from_file(WORD)
    encoder = bpe.Encoder(table)
    for chunk in (["alpha beta", "gamma delta alpha"], ["alpha epsilon", "beta zeta eta theta"], ["x y z", "alpha"]):
        assert [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(chunk)] == [lib.encode(t).ids for t in chunk]


def test_substrings(docs, none):
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs.withColumn("start", F.lit(1))).collect()}
    assert len(got) == len(ROWS)
    assert got[0]["n_words"] == got[2]["n_words"] == 0 and got[3]["kept"] == "one two"
    assert got[5]["n_removed"] == 60_000 and got[6]["kept"] == "tail"
    assert got[9]["kept"] == "a b c" and got[10]["kept"] == "x y z" and got[9]["removed"][0].asDict() == {"from": 0, "to": 80}
    assert got[12]["n_removed"] == 3000
    assert substrings.remove_repeats(none).count() == 0
    twice = substrings.remove_repeats(docs.filter("doc_id = 5").unionAll(docs.filter("doc_id = 5"))).collect()
    assert [r["n_removed"] for r in twice] == [60_000, 60_000]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_break_polynomial_hashes(spark):
    """Thue-Morse words share every polynomial hash modulo a power of two: they are no repeats and no links."""
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert {r["n_removed"] for r in substrings.remove_repeats(df).collect()} == {0}
    assert by_id(jaccard.jaccard_join(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")), "component_id") == {1: 1, 2: 2}
    x, y = (thue_morse(64, "x ", "y ") for _ in range(2))
    assert by_id(substrings.remove_repeats(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")), "n_removed") == {1: 64, 2: 64}
    y = thue_morse(64, "y ", "x ")
    apart = by_id(substrings.remove_repeats(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string"), window=64), "n_removed")
    assert apart == {1: 0, 2: 0}


def test_substrings_of_hot_anchors(monkeypatch, spark):
    """Windows counted in salted groups give what plain counting gives."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(0, 30))) + " " + PASSAGE + " " + " ".join(rng.choices("pq", k=3))) for i in range(40)]
    rows += [(100 + i, " ".join(rng.choices("st", k=120))) for i in range(5)] + [(200, "la " * 90), (201, LONG[:9000]), (202, LONG[:9000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = by_id(substrings.remove_repeats(df), "removed")
    monkeypatch.setattr(substrings, "HOT", 1)
    assert by_id(substrings.remove_repeats(df), "removed") == plain
    seen = {}
    words = {i: t.split() for i, t in rows}
    for i, w in words.items():
        for j in range(len(w) - 34):
            seen.setdefault(tuple(w[j : j + 35]), []).append((i, j))
    gone = {i: set() for i in words}
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i] |= set(range(j, j + 35))
    assert {i: {x for s in spans for x in range(s["from"], s["to"])} for i, spans in plain.items()} == gone


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "a.org", "/x")]
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.ORG/x/y?q#f"), (5, "http://b.a.org"), (6, "ftp://c.org/ü"), (7, "http://" + "h" * 9000 + "/p"), (1, None), (None, "http://a.org/x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")), rules).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1][:3] == by[2][:3] == by[3][:3] == ("", "", None) and by[4] == ("a.org", "/x/y", "a.org/x", "block")
    assert by[5][:3] == ("b.a.org", "", None) and by[6][2:] == ("org/", "allow")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_url_models_learn(spark):
    rng = random.Random(6)
    make = lambda i: (i, f"http://{rng.choice(['good', 'fine'])}{i}.org/read/{rng.choice(VOCAB)}" if i % 2 else f"http://spam{i}.com/buy/{rng.choice(VOCAB)}?win=1")
    rows = [make(i) for i in range(400)] + [(1000, "http://good7.net/read/abc"), (1001, "http://spam8.net/buy/abc?win=1")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "org", "/"), ("block", "com", "/")]).collect()}
    assert got[1000] == "allow" and got[1001] == "block"


def test_topk(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.3, (300, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (None, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    v = topk.integer_vectors(df, "vec_id", "embedding")
    got = {}
    for r in topk.maxscore_topk(v, v.filter("vec_id % 50 = 0"), 5, chunk=64, block=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    w = np.floor(256 * x.astype(float)).astype(int)
    for q in range(0, 300, 50):
        s = w @ w[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert got[q] == {k + 1: (i, int(s[i])) for k, i in enumerate(best)}
    huge = [(0, [1e30, 1.0]), (50, [-1e30, 2.0]), (51, [1e30, 3.0]), (52, [0.5, 0.25]), (53, [3e38, 3e38]), (54, [2.0**60, 5.0])]
    h = topk.integer_vectors(spark.createDataFrame(huge, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    whole = {i: [int(np.floor(256 * float(np.float32(c)))) for c in x] for i, x in huge}
    found = topk.maxscore_topk(h, h.filter("vec_id % 50 = 0"), 5).collect()
    for q in (0, 50):
        dot = {i: sum(a * b for a, b in zip(x, whole[q], strict=True)) for i, x in whole.items() if i != q}
        best = sorted(dot, key=lambda i: (-dot[i], i))
        assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, max(-(2**63), min(dot[i], 2**63 - 1))) for i in best]
    few = topk.maxscore_topk(v.filter("vec_id < 3"), v.filter("vec_id = 0"), 5)
    assert few.count() == 2
    assert topk.maxscore_topk(v.filter("false"), v.filter("false"), 5).count() == 0


def plain_topk(ids, x, asked, queries, k):
    scores = queries.astype(object) @ x.T.astype(object)
    return [(int(q), int(ids[i]), int(s[i])) for q, s in zip(asked, scores, strict=True) for i in sorted(np.flatnonzero(ids != q), key=lambda i: (-s[i], ids[i]))[:k]]


@pytest.mark.parametrize("rows", [16, topk.ROWS])
@pytest.mark.parametrize("kind", ["sphere", "clusters", "ties", "same", "beyond float32", "beyond double", "negative", "copies"])
def test_topk_of_a_shard(kind, rows, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", rows)
    rng = np.random.default_rng(8)
    n, d = 2500, 24
    size = {"beyond float32": 1e5, "beyond double": 2.0**26, "negative": 50}.get(kind, 32)
    x = rng.normal(0, size, (n, d))
    if kind == "clusters":
        x = x[rng.integers(0, 9, n)] + rng.normal(0, 1, (n, d))
    x = np.floor({"ties": np.sign(x), "negative": -np.abs(x), "copies": np.repeat(x[:50], 50, axis=0), "same": x[:1] + 0 * x}.get(kind, x)).astype(np.int64)
    ids = rng.permutation(n) // (2 if kind == "copies" else 1)
    asked = np.concatenate([np.unique(ids[:40]), [-1, n + 7]])
    queries = x[: len(asked)]
    for rows, width in ((0, d), (3, d), (3, 0), (n, 0), (n, d)):
        part = ids[:rows], x[:rows, :width], asked, queries[:, :width], 5
        assert sorted(zip(*(c.tolist() for c in topk.shard_topk(*part)), strict=True)) == sorted(plain_topk(*part))


def test_topk_costs_what_a_product_does():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (8192, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids = np.arange(len(x))

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    plain = min(seconds(lambda: np.partition(x[::16].astype(np.float32) @ x.T.astype(np.float32), len(x) - 5, axis=1)) for _ in range(3))
    assert min(seconds(lambda: topk.shard_topk(ids, x, ids[::16], x[::16], 5)) for _ in range(3)) < 20 * plain


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(stage, docs, spark, sf_dir):
    full = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("kept"), F.lit("x").alias("score"))
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, full.unionAll(full), sf_dir)
    if stage != "packing":
        assert out.columns == full.columns
    n = out.count()
    assert n > 0
    if stage == "toxicity":
        assert n == 2 * len(ROWS)
    if stage == "near_copies":
        ids = [r["doc_id"] for r in out.collect()]
        assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 5, 7, 9, 11, 12, 14, 15]
    assert f(spark, full.filter("false"), sf_dir).count() == 0


def test_packed_pieces_hold_their_ids(docs, spark, sf_dir):
    few, t = docs.filter("doc_id in (3, 9, 14)"), Tokenizer.from_file(BYTE)
    whole = {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids + [1] for r in few.collect()}
    rows = corpus_pipeline.pack(spark, few, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(whole)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
