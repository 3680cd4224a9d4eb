"""Structure repair against plain Python: every edit sequence of short conversations, a four-state programme for long ones over many blocks, edges."""

import hashlib
import itertools
import random
import re

import pytest

from parity.llm import repair

SPACE = " \t\n\v\f\r"
SHAPE = re.compile("(s?(ua)+)?")


def plain_faults(rows):
    rows = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def applied(rows, audit):
    out, left = [], list(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else left.pop(0)[:2]
        if e in "IR":
            out.append(("assistant" if out and out[-1][0][:1] == "u" else "user", "" if e == "I" else text))
        elif e == "K":
            out.append((role, text))
    assert not left
    return out


def plain_repair(rows):
    """Four states: nothing yet, after s, after u, after a."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def put(best, state, path):
        if state is not None and (state not in best or path < best[state]):
            best[state] = path

    def inserted(best):
        for _ in range(2):
            for (q, t), to in step.items():
                if t in "ua" and q in best:
                    put(best, to, (best[q][0] + 5, best[q][1] + "I"))
        return best

    best = inserted({0: (0, "")})
    for role, _, fault in rows:
        new = {}
        for q, (c, a) in best.items():
            put(new, q, (c + 2, a + "D"))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                put(new, step.get((q, role[:1])), (c + late, a + "K"))
                for t in "ua":
                    put(new, step.get((q, t)), (c + late + 1, a + "R"))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def every_repair(rows):
    """All edits with at most two insertions in a gap."""
    found = []
    for marks in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and m != "D" for (_, _, f), m in zip(rows, marks, strict=True)):
            continue
        cost = sum({"K": 0, "R": 1, "D": 2}[m] + 5 * (f == "truncated" and m != "D") for (_, _, f), m in zip(rows, marks, strict=True))
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(m + "I" * g for m, g in zip(marks, gaps[1:], strict=True))
            if SHAPE.fullmatch("".join(r[:1] for r, _ in applied(rows, audit))):
                found.append((cost + 5 * sum(gaps), audit))
    return min(found)


def plain_report(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        turns = [r[1] for r in own if r[1] is not None]
        found = plain_faults(own)
        cost, audit = plain_repair(found)
        roles = [r[:1] for r, _, _ in found]
        fixed = applied(found, audit)
        assert SHAPE.fullmatch("".join(r[:1] for r, _ in fixed))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, _, f in found) for k in ("blank", "duplicate", "truncated")),
                    sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:], strict=False)), cost, audit, sha))
    return set(out)


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, fault string, at int")
    return {tuple(r) for r in repair.report(df).collect()}


def rows_of(seed, convs, long):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "open", " ", "", "what? ", "dots...\n", None, "é!", "a.b"]
    return [
        (c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "U"]), f"{t} {x}" if (x := rng.choice(texts)) and x.strip() and rng.random() < 0.7 else x)
        for c in [*range(convs), None] for t in range(rng.choice([1, 2, 4, 8, long]))
    ]


@pytest.mark.parametrize("block", [3, 4096])
def test_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = rows_of(block, 40, 60)
    assert made(spark, rows) == plain_report(rows)


def test_every_edit_of_short_conversations():
    for role in itertools.product(["system", "user", "assistant", "tool"], repeat=3):
        for fault in itertools.product([None, "truncated", "blank"], repeat=3):
            rows = [(r, str(i), f) for i, (r, f) in enumerate(zip(role, fault, strict=True))]
            signs = "".join("-" if f == "blank" else (s.upper() if f else s) if (s := r[0]) in "sua" else "!" if f else "?" for r, _, f in rows)
            state = repair.Joined()
            for n, s in enumerate(signs):
                state.add(repair.block(s, n == 0))
            assert state.end() == plain_repair(rows) == every_repair(rows)


def test_edges(spark):
    assert made(spark, []) == set()
    rows = [(1, None, None, None), (2, 5, "user", "Hm."), (2, 5, "user", "Hm."), (3, 1, "user", "x" * 300_000 + "."), (3, 9, "assistant", "y" * 300_000 + ".")]
    assert made(spark, rows) == plain_report(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rows_in = repair.in_order(df)
    fixed = repair.repaired(rows_in, repair.audits(repair.faults(rows_in)))
    assert [(r["conv_id"], r["place"], r["role"], len(r["text"])) for r in fixed.orderBy("conv_id", "place").collect()] == [(3, 0, "user", 300_001), (3, 1, "assistant", 300_001)]


def test_one_hot_conversation_over_blocks(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" + "." * (t % 97 > 0)) for t in range(9001)]
    assert made(spark, rows) == plain_report(rows)
