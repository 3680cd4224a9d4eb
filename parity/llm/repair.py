"""Repair of conversation structure: the cheapest edits after which the roles fit a grammar.

A generalised LR parse: tables are made from the grammar's rules, stacks share their tails (a graph-structured stack), and every row of a
conversation may be kept, reroled or deleted, and roles inserted, each at its cost.  Equal stacks are merged by the smaller (cost, audit).
Since the rules recur on the left, the grammar has finitely many stacks.  So a long conversation is cut into blocks, each is parsed from
every stack that may stand before it, and the blocks are joined as a stream: (min, then least audit) is associative.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .sequences import ordered, row_key

#: Roles of a conversation by their initials: ``(s?(ua)+)?``.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Conversation", ()),
    ("Conversation", ("Turns",)),
    ("Conversation", ("s", "Turns")),
    ("Turns", ("Pair",)),
    ("Turns", ("Turns", "Pair")),
    ("Pair", ("u", "a")),
)
ROLES = {"u": "user", "a": "assistant"}  # what a row may be reroled to, or inserted as
REROLE, DELETE, INSERT, UNENDED = 1, 2, 5, 5
BLOCK = 4096  # rows parsed at once
MOST_CACHED = 1 << 16
#: A row's sign: its role's initial in lower case if the row is whole, upper case if it ends early, ``-`` if it must be deleted, ``?`` and ``!`` for a
#: whole and an early-ending row of another role.
GONE = "-"

Stack = tuple  # (state, the stack below) or ()
Best = dict  # stack -> (cost, audit)


class Grammar:
    """LR(0) item sets with SLR look-ahead."""

    def __init__(self, rules: Sequence[tuple[str, tuple[str, ...]]]) -> None:
        self.rules = [("", (rules[0][0],)), *rules]
        self.inner = {head for head, _ in rules}
        self.tokens = sorted({x for _, body in rules for x in body} - self.inner)
        follow = self._follow()
        states, self.shift, self.reduce = {self._closure({(0, 0)}): 0}, [], []
        open_ = list(states)
        while open_:
            items = open_.pop(0)
            moves = {}
            for rule, dot in items:
                body = self.rules[rule][1]
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((rule, dot + 1))
            goto = {}
            for x in sorted(moves):
                to = self._closure(moves[x])
                if to not in states:
                    states[to] = len(states)
                    open_.append(to)
                goto[x] = states[to]
            done = [r for r, dot in sorted(items) if dot == len(self.rules[r][1])]
            self.shift.append(goto)
            self.reduce.append([(r, follow[self.rules[r][0]]) for r in done])
        self.settled = [len(r) == 1 and not s and r[0][0] > 0 for s, r in zip(self.shift, self.reduce, strict=True)]

    def _closure(self, items: set) -> frozenset:
        out, new = set(items), list(items)
        while new:
            rule, dot = new.pop()
            body = self.rules[rule][1]
            if dot < len(body) and body[dot] in self.inner:
                for r, (head, _) in enumerate(self.rules):
                    if head == body[dot] and (r, 0) not in out:
                        out.add((r, 0))
                        new.append((r, 0))
        return frozenset(out)

    def _follow(self) -> dict[str, set[str]]:
        empty, first, follow = set(), {x: {x} for x in self.tokens} | {x: set() for x in self.inner}, {x: set() for x in self.inner} | {"": {"$"}}
        size = -1
        while size != (size := len(empty) + sum(map(len, first.values())) + sum(map(len, follow.values()))):
            for head, body in self.rules:
                if head and all(x in empty for x in body):
                    empty.add(head)
                for x in body:
                    if head:
                        first[head] |= first[x]
                    if x not in empty:
                        break
                after = set(follow[head])
                for x in reversed(body):
                    if x in self.inner:
                        follow[x] |= after
                    after = (after | first[x]) if x in empty else set(first[x])
        return follow

    def _reduced(self, stack: Stack, rule: int) -> Stack:
        head, body = self.rules[rule]
        for _ in body:
            stack = stack[1]
        return (self.shift[stack[0]][head], stack)

    @lru_cache(maxsize=4096)  # noqa: B019  the grammar lives as long as the process
    def after(self, stack: Stack, token: str) -> tuple[Stack, ...]:
        """The stacks that a token leads to (none, if it does not fit): reductions that it allows, then its shift.  A state that can only
        reduce does so at once, whatever comes next."""
        out, open_ = [], [stack]
        while open_:
            s = open_.pop()
            open_ += [self._reduced(s, r) for r, ahead in self.reduce[s[0]] if r and token in ahead]
            if token in self.shift[s[0]]:
                to = (self.shift[s[0]][token], s)
                while self.settled[to[0]]:
                    to = self._reduced(to, self.reduce[to[0]][0][0])
                out.append(to)
        return tuple(out)

    @lru_cache(maxsize=4096)  # noqa: B019
    def accepts(self, stack: Stack) -> bool:
        return any((not r and "$" in ahead) or (r and "$" in ahead and self.accepts(self._reduced(stack, r))) for r, ahead in self.reduce[stack[0]])

    def stacks(self) -> list[Stack]:
        """All stacks that any tokens lead to, in a fixed order."""
        out, i = [(0, ())], 0
        while i < len(out):
            out += [s for t in self.tokens for s in self.after(out[i], t) if s not in out]
            i += 1
        return out


GRAMMAR = Grammar(RULES)
STACKS = GRAMMAR.stacks()


def _merge(best: Best, stack: Stack, cost: int, audit: str) -> bool:
    if stack not in best or (cost, audit) < best[stack]:
        best[stack] = (cost, audit)
        return True
    return False


def _inserted(best: Best) -> Best:
    """best with every row of insertions that is cheapest for its stack."""
    open_ = list(best)
    while open_:
        stack = open_.pop()
        cost, audit = best[stack]
        open_ += [to for token in ROLES for to in GRAMMAR.after(stack, token) if _merge(best, to, cost + INSERT, audit + "I")]
    return best


def parse(signs: str, best: Best) -> Best:
    """The stacks after rows of these signs, each with its cheapest (cost, audit); roles are inserted before rows only, so that all audits
    end with a row's edit and none begins another."""
    for sign in signs:
        new: Best = {}
        for stack, (cost, audit) in _inserted(dict(best)).items():
            _merge(new, stack, cost + DELETE, audit + "D")
            if sign != GONE:
                more = cost + (UNENDED if sign.isupper() or sign == "!" else 0)
                for to in GRAMMAR.after(stack, sign.lower()):
                    _merge(new, to, more, audit + "K")
                for token in ROLES:
                    for to in GRAMMAR.after(stack, token):
                        _merge(new, to, more + REROLE, audit + "R")
        best = new
    return best


@lru_cache(maxsize=MOST_CACHED)
def block(signs: str, first: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(stack before, stack after, cost, audit) by number; the first block begins with the empty stack only."""
    return tuple((i, STACKS.index(s), c, a) for i in ([0] if first else range(len(STACKS))) for s, (c, a) in parse(signs, {STACKS[i]: (0, "")}).items())


class Joined:
    """The parse of blocks joined one after another.  Audits are chains that share what came before, ordered by rank: no audit
    that ends with a row's edit begins another of as many rows, so that earlier blocks decide first."""

    def __init__(self) -> None:
        self.best = {0: (0, 0, ())}  # number of the stack: cost, rank of the audit so far, (earlier pieces, the last piece)

    def add(self, pieces) -> None:
        found: dict[int, tuple] = {}
        for i, j, cost, audit in pieces:
            if i in self.best:
                before, rank, chain = self.best[i]
                option = (before + cost, rank, audit, chain)
                if j not in found or option[:3] < found[j][:3]:
                    found[j] = option
        ranks = {k: n for n, k in enumerate(sorted({x[1:3] for x in found.values()}))}
        self.best = {j: (c, ranks[rank, audit], (chain, audit)) for j, (c, rank, audit, chain) in found.items()}

    def end(self) -> tuple[int, str]:
        last: Best = {}
        for j, (cost, _, chain) in self.best.items():
            parts = []
            while chain:
                chain, piece = chain
                parts.append(piece)
            last[STACKS[j]] = (cost, "".join(reversed(parts)))
        return min(x for stack, x in _inserted(last).items() if GRAMMAR.accepts(stack))


def signs_of(role: Column, gone: Column, unended: Column) -> Column:
    """Each row's sign."""
    initial = F.substring(role, 1, 1)
    known = initial.isin(*GRAMMAR.tokens)
    return F.when(gone, GONE).when(known, F.when(unended, F.upper(initial)).otherwise(initial)).when(unended, "!").otherwise("?")


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn, role, text, key, blank, whole): the rows of every conversation by turn (null first), then role and text, with their
    digest, whether they have nothing but white space, and whether the last other character is one of ``.!?``.  Null role and text: one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", "turn", space("role"), space("text"))
    rows = rows.withColumns({"key": row_key(F.col("role"), F.col("text")), "blank": ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), "whole": F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*+\\z")})
    return ordered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["turn", "role", "text", "key", "blank", "whole"])


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, role, fault) of rows in order: blank, duplicate (role and text of an earlier row of the conversation), truncated (does
    not end whole), or null.  The first that holds counts."""
    first = rows.groupBy(F.col("conv_id").alias("__c"), F.col("key").alias("__k")).agg(F.min("at").alias("__first"))
    both = rows.select("conv_id", "at", "turn", "role", "key", "blank", "whole").join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("key") == F.col("__k")))
    fault = F.when(F.col("blank"), "blank").when(F.col("__first") < F.col("at"), "duplicate").when(~F.col("whole"), "truncated")
    return both.select("conv_id", "at", "turn", "role", fault.alias("fault"))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of rows (conv_id, at, role, fault), places 0, 1, 2 ... in each conversation: the cheapest edits (K kept, R reroled,
    D deleted, I inserted), the ASCII-least of equal cost, and how many neighbours have initials that no two turns of the grammar have.

    Blocks of rows are parsed by themselves; the task that joins a conversation's blocks sees one row for 4096 of its turns.
    """
    is_ = lambda *kinds: F.coalesce(F.col("fault").isin(*kinds), F.lit(False))
    cut = rows.select("conv_id", F.floor(F.col("at") / BLOCK).alias("nth"), "at", signs_of(F.col("role"), is_("blank", "duplicate"), is_("truncated")).alias("sign"), F.substring("role", 1, 1).alias("initial"))
    cut = cut.groupBy("conv_id", "nth").agg(F.sort_array(F.collect_list(F.struct("at", "sign", "initial"))).alias("s"))
    cut = cut.select("conv_id", "nth", F.array_join(F.transform("s", lambda x: x["sign"]), "").alias("signs"), F.transform("s", lambda x: x["initial"]).alias("initials"))
    near = F.expr("size(filter(sequence(1, size(initials)), i -> i > 1 and not concat(initials[i - 2], initials[i - 1]) in ('su', 'ua', 'au')))")
    cut = cut.select("conv_id", "nth", "signs", near.cast("long").alias("illegal"), F.col("initials")[0].alias("first"), F.element_at("initials", -1).alias("last"))
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    names = ["i", "j", "cost", "audit"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, p, strict=True)) for p in block(s, n == 0)] for n, s in zip(batch.column("nth").to_pylist(), batch.column("signs").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("signs"), "pieces", pa.array(found, kind))

    done = cut.mapInArrow(parsed, "conv_id long, nth long, pieces array<struct<i:int,j:int,cost:long,audit:string>>, illegal long, first string, last string")
    done = done.repartition("conv_id").sortWithinPartitions("conv_id", "nth")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, illegal, before, out = (), None, 0, "", []
        for batch in batches:
            cols = (batch.column(c) for c in ("conv_id", "illegal", "first", "last", "pieces"))
            for conv, bad, first, last, pieces in zip(*cols, strict=True):
                if key != (conv.as_py(),):
                    if key:
                        out.append((*key, illegal, *state.end()))
                    key, state, illegal, before = (conv.as_py(),), Joined(), 0, None
                state.add(tuple(p.values()) for p in pieces.as_py())
                illegal += bad.as_py() + (before is not None and before + first.as_py() not in ("su", "ua", "au"))
                before = last.as_py()
            if len(out) > 4096:
                yield _batch(out, AUDITS)
                out = []
        if key:
            out.append((*key, illegal, *state.end()))
        if out:
            yield _batch(out, AUDITS)

    return done.mapInArrow(joined, "conv_id long, illegal long, cost long, audit string")


AUDITS = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _after(stack: Stack, role: str | None, audit: str) -> tuple[Stack, str]:
    """The stack after one more row and its role; a role that is to be found is the one that fits."""
    for token in [role[:1]] if role is not None else ROLES:
        for to in GRAMMAR.after(stack, token):
            return to, role if role is not None else ROLES[token]
    raise ValueError(f"{audit} does not fit the rows")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text) of repaired rows, conversation by conversation; the row that brings a conversation's audit comes first."""

    def inserted() -> Iterator[tuple]:
        nonlocal at, place, stack
        while at < len(audit) and audit[at] == "I":
            stack, role = _after(stack, None, audit)
            yield conv, place, role, ""
            at, place = at + 1, place + 1

    conv, audit, at, place, stack = None, "", 0, 0, STACKS[0]
    for batch in batches:
        for c, own, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text")), strict=True):
            if own is not None:
                yield from inserted()
                conv, audit, at, place, stack = c, own, 0, 0, STACKS[0]
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit != "D":
                stack, role = _after(stack, role if edit == "K" else None, audit)
                yield conv, place, role, text
                place += 1
    yield from inserted()


def _with_audits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("conv_id", "at", none("string").alias("audit"), "role", "text")
    both = both.unionByName(edits.select("conv_id", F.lit(-1).cast("long").alias("at"), "audit", none("string").alias("role"), none("string").alias("text")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of rows (conv_id, at, role, text) after their conversation's edits (conv_id, audit): the rows go by as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _edited(batches):
            held.append(row)
            size += len(row[3])
            if size > 1 << 20 or len(held) > 4096:
                yield _batch(held, REPAIRED)
                held, size = [], 0
        if held:
            yield _batch(held, REPAIRED)

    return _with_audits(rows, edits).mapInArrow(run, "conv_id long, place long, role string, text string")


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired ``role:text`` lines, for conversations that keep a row.  A hash is sequential: a
    conversation is one task's stream, in bounded memory beside its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, state = [], (), None
        for conv, _, role, text in _edited(batches):
            if key != (conv,):
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (conv,), hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
            if len(out) > 4096:
                yield _batch(out, DIGESTS)
                out = []
        if key:
            out.append((*key, state.hexdigest()))
        if out:
            yield _batch(out, DIGESTS)

    return _with_audits(rows, edits).mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    conversations: (conv_id, turn, role, text); null ids are one conversation, null turns come first and leave no gap, null role and text are
    one space; equal turns go by role and text; repeated rows are duplicates.  No rows: an empty table.  Other columns are left out.
    """
    rows = in_order(conversations)
    found = written(faults(rows), "faults")
    edits = written(audits(found), "audits")
    of = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = found.groupBy("conv_id").agg(gaps.alias("gaps"), of("blank"), of("duplicate"), of("truncated"))
    out = counts
    for more in (edits, repaired_digests(rows, edits)):
        more = more.withColumnRenamed("conv_id", "__c")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
