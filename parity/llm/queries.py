"""The registered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, jaccard, langid, packing, repair, secrets, substrings, topk, toxicity, trie, urls
from .sequences import ordered, row_key

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprints.edited_and_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), k=5, percent=75)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")


TOOLS: chat.Schema = {
    "measure": {"chars": ("integer", True), "opening": ("string", False)},
    "search": {"limit": ("number", False), "query": ("string", True)},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations, whole texts and all turns, played as tool use: an assistant's turn is a call that follows the call of half its turn
    number, a user's turn is the result of the call before it, a system turn stays as it is.  Calls are numbered within their conversation."""
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    n = F.length("text")
    name = F.when(F.col("turn") % 4 == 1, "search").when(n % 11 == 0, "guess").otherwise("measure")
    search = F.to_json(F.struct(F.col("text").alias("query"), (n % 10 + 0.5).alias("limit")))
    measure = F.to_json(F.struct(F.col("text").alias("opening"), F.when(n % 7 > 0, n).alias("chars")))
    after = F.when(F.col("turn") >= 2, F.array(call_id(F.floor(F.col("turn") / 2)))).otherwise(F.array().cast("array<string>"))
    body = F.struct(call_id(F.col("turn")).alias("id"), name.alias("name"), F.parse_json(F.when(F.col("turn") % 4 == 1, search).otherwise(measure)).alias("arguments"), after.alias("after"))
    calls = conversations.filter("role = 'assistant'").select("conv_id", "turn", "role", F.to_json(F.struct(body.alias("tool_call"))).alias("text"))
    answer = F.struct(call_id(F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    results = conversations.filter("role = 'user'").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(answer.alias("tool_result"))).alias("text"))
    return calls.unionByName(results).unionByName(conversations.filter("role = 'system'").select("conv_id", "turn", "role", "text"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(tool_messages(table(spark, sf_dir, "conversations")), TOOLS)


def held_out() -> Column:
    """Rows whose labels are not learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    done = toxicity.score(docs, model)
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "offending")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk.maxscore_topk(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with a tenth of their rows dropped, emptied, left open, repeated or given to the user, by a hash of id and turn (nulls: one space)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    role = F.when(how == 4, "user").otherwise(space("role"))
    text = F.when(how == 1, "").when(how == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.filter(how != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(how == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("n")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    done = repair.report(damaged(conversations)).withColumnRenamed("conv_id", "__c")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(done, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    none = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select("conv_id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def shared_openings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, digest, chars) and members (conv_id, length) after every conversation c got the first h turns of c - c % 100 in place of
    its own first h, h = crc32 of c in decimal % 6.  Turns go by turn, null first, then role and text; rows without conv_id are no conversation's."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    turns = turns.withColumns({"digest": row_key(F.col("role"), F.col("text")), "chars": F.length("text").cast("long")})
    turns = ordered(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["digest", "chars"])
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = turns.filter("conv_id % 100 = 0 and at < 5").groupBy(F.col("conv_id").alias("head")).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("opening"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    members = own.withColumns({"h": h, "head": F.expr("conv_id - conv_id % 100")}).join(head, "head", "left")
    members = members.withColumn("opening", F.slice(F.coalesce("opening", F.array()), 1, F.col("h").cast("int"))).withColumn("k", F.size("opening").cast("long"))
    members = members.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    new = members.select("conv_id", F.explode("opening").alias("t")).select("conv_id", "t.*")
    rest = turns.join(members.select("conv_id", "h", "k"), "conv_id").filter("at >= h").select("conv_id", F.expr("at - h + k").alias("at"), "digest", "chars")
    return new.unionByName(rest), members.select("conv_id", "length")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*shared_openings(table(spark, sf_dir, "conversations")))


OP3_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

OP5_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id || ':' || turn AS k, text, length(text) AS n,
         CASE WHEN turn % 4 = 1 THEN 'search' WHEN length(text) % 11 = 0 THEN 'guess' ELSE 'measure' END AS name,
         CASE WHEN turn >= 2 THEN conv_id || ':' || (turn // 2) END AS dep
       FROM conversations WHERE role = 'assistant'),
 r AS (SELECT conv_id || ':' || (turn - 1) AS k, to_json(text) AS content FROM conversations WHERE role = 'user'),
 l AS (SELECT k, 0 AS level FROM c WHERE dep IS NULL OR dep NOT IN (SELECT k FROM c)
       UNION ALL SELECT c.k, l.level + 1 FROM l JOIN c ON c.dep = l.k),
 a AS (SELECT c.*, l.level, r.content, dep IS NOT NULL AND dep NOT IN (SELECT k FROM c) AS lost,
         CASE WHEN turn % 4 = 1 THEN '{"limit":' || (n % 10) || '.5,"query":' || to_json(text) || '}'
              ELSE '{' || CASE WHEN n % 7 > 0 THEN '"chars":' || n || ',' ELSE '' END || '"opening":' || to_json(text) || '}' END AS args,
         CASE WHEN name = 'measure' AND n % 7 = 0 THEN 'missing chars' ELSE '' END AS errors
       FROM c JOIN l USING (k) LEFT JOIN r USING (k))
SELECT conv_id, turn, 'call_' || turn AS call_id, name, level,
       CASE WHEN name = 'guess' THEN 'unknown tool' WHEN errors <> '' THEN 'invalid arguments' WHEN lost THEN 'missing predecessor'
            WHEN content IS NULL THEN 'no result' ELSE 'ok' END AS status,
       errors, '{"arguments":' || args || ',"id":"call_' || turn || '","name":"' || name || '","result":' || coalesce(content, 'null') || '}' AS record
FROM a
"""

OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 v AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
 m AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
 g AS (SELECT DISTINCT r, i + j AS p FROM v JOIN m USING (h), range(35) AS t(j)),
 a AS (SELECT r, list(p) AS gone FROM g GROUP BY r),
 k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN a USING (r))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM k
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
       FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

#: CRC-32 of an ASCII text {0}, bit by bit.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

def _edit(path: str, cost: str, mark: str) -> str:
    """A path is ten digits of cost and then the audit, so that the least text is the cheapest path."""
    return f"(lpad(CAST(CAST({path}[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || {path}[11:] || '{mark}')"


#: u and a after insertions, then a row's edits; z, s, u, a: nothing yet, after system, user, assistant.
_U = f"least(u, {_edit('z', '5', 'I')}, {_edit('s', '5', 'I')}, {_edit('a', '5', 'I')})"
_A = f"least(a, {_edit('iu', '5', 'I')})"
_NEW = {t: [f"CASE WHEN NOT gone AND x = '{t}' THEN {_edit(f, 'late', 'K')} END" for f in froms] + ([f"CASE WHEN NOT gone THEN {_edit(f, 'late + 1', 'R')} END" for f in froms] if t in "ua" else [])
        for t, froms in {"s": ["z"], "u": ["z", "s", "ia"], "a": ["iu"]}.items()}

OP11_SQL = f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC_SQL.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS how FROM conversations),
 d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) FROM r WHERE how <> 0),
 o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
 f AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
 g AS (SELECT conv_id, turn, role, text, i, role[1] AS x, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated,
         prev IS NOT NULL AND prev[1] || role[1] NOT IN ('su', 'ua', 'au') AS illegal, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS late FROM f),
 c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
 p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '0000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM c
   UNION ALL SELECT conv_id, i, {_edit('z', '2', 'D')}, least({_edit('s', '2', 'D')}, {', '.join(_NEW['s'])}), least({_edit('iu', '2', 'D')}, {', '.join(_NEW['u'])}), least({_edit('ia', '2', 'D')}, {', '.join(_NEW['a'])})
   FROM (SELECT *, {_A} AS ia FROM (SELECT g.conv_id, g.i, z, s, a, {_U} AS iu, x, gone, late FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1))),
 e AS (SELECT conv_id, least(z, {_A}) AS best FROM (SELECT p.*, {_U} AS iu FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i)),
 m AS (SELECT conv_id, CAST(best[1:10] AS BIGINT) AS cost, best[11:] AS audit FROM e),
 k AS (SELECT conv_id, j, audit[j] AS edit, length(replace(audit[1:j], 'I', '')) AS i FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM m)),
 l AS (SELECT k.*, g.role, g.text, row_number() OVER (PARTITION BY k.conv_id ORDER BY j) - 1 AS n FROM k LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id AND g.i = k.i WHERE edit <> 'D'),
 h AS (SELECT *, max(CASE WHEN n = 0 AND edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM l),
 t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY n) AS lines FROM h GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id
"""

OP13_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS own, {CRC_SQL.format('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM t GROUP BY conv_id),
 r AS (SELECT c.conv_id, list_concat(coalesce(p.own, [])[1:c.h], c.own[c.h + 1:]) AS s FROM c LEFT JOIN c p ON p.conv_id = c.conv_id - c.conv_id % 100),
 o AS (SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s FROM r),
 k AS (SELECT conv_id, depth, s[1:depth] AS k, len(s) = depth AS ends, CASE WHEN depth = 0 THEN 0 ELSE length(s[depth].text) END AS chars FROM o),
 n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM k GROUP BY k, depth),
 f AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.k[1:n.depth] = n.k) AS n_children
       FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1])
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
       CAST(sum((x.n_convs - 1) * x.chars) AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN f x ON x.depth >= f.depth AND x.k[1:f.depth] = f.k GROUP BY ALL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_scan": op4_secret_scan,
    "op5_tool_calls": op5_tool_calls,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_maxscore": op10_maxscore,
    "op11_structure_repair": op11_structure_repair,
    "op12_language_id": op12_language_id,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op3_jaccard_join": OP3_SQL,
    "op5_tool_calls": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_maxscore": OP10_SQL,
    "op11_structure_repair": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
