"""Tool-call linking for chat records, in DataFrame functions only.

Calls and results are hash-joined by identifier, which counts within its conversation; calls are ordered topologically by what they
say they follow, arguments are validated against the tools' schemas, and every linked call is serialised as canonical
JSON (sorted keys, no white space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: JSON schema types and the variant types that satisfy them.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)",
    "boolean": "BOOLEAN",
    "object": "OBJECT.*",
    "array": "ARRAY.*",
}

Schema = dict[str, dict[str, tuple[str, bool]]]  # tool -> parameter -> (type, required)


def messages_parsed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results among messages (conv_id, turn, role, text).

    A call is an assistant's JSON object {"tool_call": {"id", "name", "arguments", "after": [ids]}}, a result a tool's
    {"tool_result": {"id", "content"}}; any other text, null included, is neither.  key names a call: conversation and
    identifier; deps are the keys of the calls that it follows.
    """
    v = F.try_parse_json("text")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    parsed = messages.select("conv_id", "turn", "role", v.alias("v")).filter("v is not null")
    calls = parsed.filter("role = 'assistant'").select(
        "conv_id", "turn", get("$.tool_call.id", "string").alias("call_id"), get("$.tool_call.name", "string").alias("name"),
        get("$.tool_call.arguments", "variant").alias("arguments"), get("$.tool_call.after", "array<string>").alias("after"),
    ).filter("call_id is not null or name is not null")
    results = parsed.filter("role = 'tool'").select("conv_id", "turn", get("$.tool_result.id", "string").alias("call_id"), get("$.tool_result.content", "variant").alias("content"))
    key = lambda i: F.when(i.isNotNull(), F.to_json(F.array(F.col("conv_id").cast("string"), i)))
    calls = calls.withColumn("key", key(F.col("call_id"))).withColumn("deps", F.array_compact(F.transform("after", key)))
    return calls, results.filter("call_id is not null").withColumn("key", key(F.col("call_id")))


def argument_errors(tools: Schema) -> Column:
    """Sorted list of what is wrong with a call's arguments under its tool's schema; null for an unknown tool."""
    out = F.lit(None).cast("array<string>")
    for tool, params in sorted(tools.items()):
        found = []
        for p, (kind, required) in sorted(params.items()):
            got = F.schema_of_variant(F.try_variant_get("arguments", f"$['{p}']", "variant"))
            missing = F.when(F.lit(required) & (got.isNull() | (got == "VOID")), F.lit(f"missing {p}"))
            found.append(F.coalesce(missing, F.when(got.isNotNull() & (got != "VOID") & ~got.rlike(f"^{TYPES[kind]}$"), F.lit(f"{p} is no {kind}"))))
        keys = F.coalesce(F.json_object_keys(F.to_json("arguments")), F.array().cast("array<string>"))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, params)).cast("array<string>")), lambda k: F.concat(F.lit("unexpected "), k))
        errors = F.array_sort(F.concat(F.array_compact(F.array(*found).cast("array<string>")), extra))
        out = F.when(F.col("name") == tool, errors).otherwise(out)
    return out


def _jumps(one: DataFrame) -> DataFrame:
    """(key, to, w, open) for calls with one predecessor (key, to): the nearest one behind it that has none or several, w steps away; open:
    there is none, the chain is a cycle.  Pointers double their reach in every round."""
    jump = written(one.select("key", "to", F.lit(1).cast("long").alias("w"), F.lit(True).alias("open")), "jump")
    for _ in range(jump.count().bit_length() + 1):
        far = jump.select(F.col("key").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"))
        jump = jump.join(far, "to", "left").select("key", F.coalesce("to2", "to").alias("to"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.col("to2").isNotNull().alias("open"))
        jump = written(jump, "jump")
        if jump.filter("open").isEmpty():
            break
    return jump


def levels(calls: DataFrame) -> DataFrame:
    """(key, level) of calls (key, deps): longest chain of predecessors; null for a call in, or behind, a cycle.

    Chains of calls with one predecessor each are cut short by pointer doubling, in rounds that grow with the logarithm of their length;
    calls with several are peeled round by round, as many as the longest chain of such calls.  Predecessors that do
    not exist are no edges.
    """
    ids = calls.filter("key is not null").select("key").distinct()
    edges = calls.select("key", F.explode("deps").alias("dep")).distinct().filter("key is not null")
    edges = written(edges.join(ids.withColumnRenamed("key", "dep"), "dep", "left_semi"), "edges")
    degree = edges.groupBy("key").agg(F.count("*").alias("n"), F.min("dep").alias("to"))
    nodes = written(ids.join(degree, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "to"), "nodes")
    jump = _jumps(nodes.filter("n = 1").select("key", "to"))
    done = nodes.filter("n = 0").select("key", F.lit(0).cast("long").alias("level"))
    left, front = nodes.filter("n > 1").select("key", "n", F.lit(0).cast("long").alias("best")), done
    if not left.isEmpty():
        short = jump.select(F.col("key").alias("dep"), F.col("to").alias("at"), "w", "open")
        several = edges.join(left.select("key"), "key", "left_semi").join(short, "dep", "left")
        several = several.filter("open is null or not open").select("key", F.coalesce("at", "dep").alias("at"), (F.coalesce("w", F.lit(0)) + 1).alias("w"))
        several = written(several, "edges")
        while True:
            met = several.join(front.withColumnRenamed("key", "at"), "at").groupBy("key").agg(F.count("*").alias("met"), F.max(F.col("level") + F.col("w")).alias("far"))
            met = left.join(met, "key", "left").select("key", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"), F.greatest("best", F.coalesce("far", F.lit(0))).alias("best"))
            met = written(met, "left")
            front, left = met.filter("n = 0").select("key", F.col("best").alias("level")), met.filter("n > 0")
            if front.isEmpty():
                break
            done = done.unionByName(front)
    ends = done.select(F.col("key").alias("to"), "level")
    chained = jump.filter("not open").join(ends, "to").select("key", (F.col("level") + F.col("w")).alias("level"))
    return nodes.select("key").join(done.unionByName(chained), "key", "left").select("key", F.col("level").cast("int").alias("level"))


def link_tool_calls(messages: DataFrame, tools: Schema) -> DataFrame:
    """One row per call: conv_id, turn, call_id, name, level, status, errors, record.

    (conv_id, level, turn) is a topological order of a conversation's calls.  record is canonical JSON of arguments, id, name and
    result.  status: ``no id``, ``unknown tool``, ``invalid arguments``, ``cycle``, ``missing predecessor``, ``no result``, ``result before
    call`` or ``ok``, the first that holds.  Identifiers count within a conversation (rows without one are a
    conversation).  Of several results for one id the earliest turn (then the smallest JSON; one without a turn comes last) counts; repeated call
    rows are linked each; an empty table gives no rows.
    """
    calls, results = messages_parsed(messages)
    calls = calls.withColumn("errors", argument_errors(tools))
    first = results.select("key", F.struct(F.col("turn").isNull().alias("undated"), "turn", F.to_json("content").alias("json")).alias("r")).groupBy("key").agg(F.min("r").alias("r"))
    order = levels(calls)
    known = calls.filter("key is not null").select(F.col("key").alias("dep")).distinct()
    lost = calls.select("key", F.explode("deps").alias("dep")).filter("key is not null").join(known, "dep", "left_anti").select("key").distinct().withColumn("lost", F.lit(True))
    linked = calls.filter("key is not null").join(first, "key", "left").join(order, "key", "left").join(lost, "key", "left")
    unnamed = calls.filter("key is null")  # they meet nothing, and as many as there are share no join key
    linked = linked.unionByName(unnamed.select(*calls.columns, *(F.lit(None).cast(linked.schema[c].dataType).alias(c) for c in ("r", "level", "lost"))))
    status = (
        F.when(F.col("key").isNull(), "no id").when(F.col("errors").isNull(), "unknown tool").when(F.size("errors") > 0, "invalid arguments")
        .when(F.col("level").isNull(), "cycle").when(F.col("lost"), "missing predecessor").when(F.col("r").isNull(), "no result")
        .when(F.col("r.turn") <= F.col("turn"), "result before call").otherwise("ok")
    )
    record = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", F.try_parse_json(F.col("r.json")).alias("result")), {"ignoreNullFields": "false"})
    return linked.select("conv_id", "turn", "call_id", "name", "level", status.alias("status"), F.array_join(F.coalesce("errors", F.array().cast("array<string>")), "; ").alias("errors"), record.alias("record"))
