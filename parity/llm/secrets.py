"""Secret scan with a random forest that removes false positives, in DataFrame functions and Spark ML only.

Candidates are the values of any length and characters that are assigned to a name with a keyword, and the long runs of key
characters in a text.  Their features: length, shares and transitions of character
classes, coverage by a dictionary of the corpus's own frequent words, signs of a path, and the neighbouring words.
A forest fitted on labelled findings decides which candidates are secrets.

Where nobody has labelled findings they are planted: values of a known kind, drawn by hash, in surroundings taken from the corpus.
Their label is how they were made (random key material, or words, paths, rulers, numbers and identifiers), no function of a
feature.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CONTEXT = 40  # code points kept on each side
DICTIONARY_WORDS = 256  # the proven bound of the broadcast dictionary
MOST_LABELLED = 20_000  # labelled findings that the forest is fitted on, drawn by hash
ROUNDS = 4  # planted values of each kind for one place of the corpus
TREES, DEPTH, SEED = 20, 6, 7

# Words that announce a credential, and signs of a path or an address.
WORDS = "secret|token|passw|passwd|pwd|api|apikey|key|auth|bearer|credential|private|access"
KEYWORDS = f"(?i)({WORDS})"
ASSIGNS = "(?:=>|:=|[=:])"
PATHS = "(://|www\\.|\\.[a-z]{2,4}/|[a-z0-9]/[a-z0-9])"

# A name with a keyword, of any length and with any space around the sign, and its assigned value (quoted: up to the quote; else up to a space, a
# quote or the next parameter of a url), or a run of key characters.  A name is looked into only where a sign follows it, and runs
# are possessive, so that the work is linear in the text.
NAME = "[A-Za-z0-9_\\-]"
SIGN = f"[\"'`]?\\s*+{ASSIGNS}\\s*+"
NAMED = f"(?<!{NAME})(?={NAME}++{SIGN})(?={NAME}*?(?i:{WORDS})){NAME}++{SIGN}"
VALUE = "(?:\"[^\"\\n]+(?=\")|'[^'\\n]+(?=')|`[^`\\n]+(?=`)|(?!=)(?:(?!&\\w+=)[^\\s\"'`])++)"
RUN = "[A-Za-z0-9+/_=\\-]"
CANDIDATE = f"{NAMED}{VALUE}|(?<!{RUN}){RUN}{{16,}}"

FEATURES = ["length", "digits", "uppers", "lowers", "marks", "turns", "vowels", "kinds", "hexadecimal", "covered", "path", "path_near", "keyword", "assigned", "quoted"]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(sizes: Column) -> Column:
    """[0, s0, s0 + s1, ...] without the total, by blocks of about the root of their number: adding to an array copies it, and a text may
    hold very many candidates."""
    scan = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def of(xs: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), step), lambda at: scan(F.slice(xs, at, step)))
        return _let(blocks, lambda bs: _let(scan(F.transform(bs, lambda b: F.element_at(b, -1))), lambda base: moved(bs, base)))

    def moved(bs: Column, base: Column) -> Column:
        return F.flatten(F.transform(bs, lambda b, i: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + F.get(base, i))))

    return _let(sizes, of)


def _name(found: Column) -> Column:
    """What stands before the value in a find: the name it is assigned to, and an opening quote."""
    return F.regexp_extract(found, f"^({NAMED}[\"'`]?)(?=[^=])", 1)


def _pieces(text: Column) -> tuple[Column, Column]:
    """The pieces of a text between its finds, and the finds."""
    return F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, nth, start, value, before, after) of every candidate of docs (doc_id, text); nth counts a text's candidates from 0, start
    its code points.

    k1 is a hash of id and text, so that rows that share an id stay apart.  Null and empty texts have none.
    """
    pieces, found = _pieces(F.col("text"))
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), pieces.alias("p"), found.alias("m"))
    starts = _running(F.transform("p", lambda x, i: F.length(x) + F.coalesce(F.length(F.get("m", i)), F.lit(0))))  # of the pieces
    placed = F.transform(
        "m",
        lambda v, i: F.struct(
            i.alias("nth"), (F.get("starts", i) + F.length(F.get("p", i)) + F.length(_name(v))).alias("start"), F.substr(v, F.length(_name(v)) + 1).alias("value"),
            F.right(F.concat(F.get("p", i), _name(v)), F.lit(CONTEXT)).alias("before"), F.substring(F.get("p", i + 1), 1, CONTEXT).alias("after"),
        ),
    )
    rows = rows.withColumn("starts", starts)
    return rows.select("doc_id", "k1", F.explode(placed).alias("c")).select("doc_id", "k1", "c.*")


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three to eight letters over all texts (ties by spelling): a top-k report of bounded size."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\b([a-z]{3,8})\\b"), F.lit(1)))
    top = docs.select(word.alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(most)
    return [r["w"] for r in top.collect()]


def _share(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]", "")) / F.length(value)


def featured(found: DataFrame, words: list[str]) -> DataFrame:
    """found with the columns FEATURES."""
    v, n = F.col("value"), F.length("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"), "(?s)[^0Aa]", "-")
    turns = n - F.length(F.regexp_replace(classes, "(.)\\1+", "$1"))  # letters that repeat their neighbour's class
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    covered = 1 - F.length(F.regexp_replace(F.lower(v), "|".join(longest_first), "")) / n if words else F.lit(0.0)
    near = F.right(F.col("before"), F.lit(30))
    as_number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.select(
        "*", n.cast("double").alias("length"), _share(v, "0-9").alias("digits"), _share(v, "A-Z").alias("uppers"), _share(v, "a-z").alias("lowers"),
        (1 - _share(v, "0-9A-Za-z")).alias("marks"), (1 - turns / n).alias("turns"), _share(v, "aeiouAEIOU").alias("vowels"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64))).alias("kinds"), as_number(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hexadecimal"),
        covered.cast("double").alias("covered"), as_number(v.rlike(PATHS)).alias("path"), as_number(near.rlike(PATHS) | F.col("after").rlike(PATHS)).alias("path_near"),
        as_number(near.rlike(KEYWORDS)).alias("keyword"), as_number(near.rlike(f"{ASSIGNS}\\s*[\"'`]?$")).alias("assigned"),
        as_number(near.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).alias("quoted"),
    )


#: Names that planted findings are assigned to, and what stands between name and value.
NAMES = ["api_key", "token", "password", "client_secret", "auth", "access_key", "db.password", "PRIVATE_TOKEN"]
SIGNS = [' = "', '="', ": '", "=", ": ", " := "]
KINDS = 12


def planted(found: DataFrame, words: list[str], most: int = MOST_LABELLED) -> DataFrame:
    """(value, before, after, label) of values made for the purpose, in the surroundings of at most ``most / (KINDS * ROUNDS)`` candidates of
    the corpus, drawn by hash.  Half of all places announce the value by a name, whatever its label."""
    places = found.select("before", "after", F.sha2(F.concat_ws("|", "value", "before", "after"), 256).alias("h")).orderBy("h", "before", "after").limit(max(1, most // (KINDS * ROUNDS)))
    rows = places.select("before", "after", F.explode(F.sequence(F.lit(0), F.lit(KINDS * ROUNDS - 1))).alias("i"), "h")
    rows = rows.withColumn("h", F.sha2(F.concat_ws("-", "h", "i"), 256)).withColumn("kind", F.col("i") % KINDS)
    draw = lambda tag, n: F.pmod(F.xxhash64("h", F.lit(tag)), F.lit(n)).cast("int")
    one_of = lambda tag, xs: F.element_at(F.array(*map(F.lit, xs)), draw(tag, len(xs)) + 1)
    some = words or ["word", "name", "file"]
    word = lambda tag: one_of(tag, some)
    digest = F.concat("h", F.sha2("h", 256))  # 128 hexadecimal digits
    code = F.regexp_replace(F.concat(F.base64(F.unhex("h")), F.base64(F.unhex(F.sha2("h", 256)))), "=", "")
    plain, digits = F.regexp_replace(code, "[+/]", ""), F.regexp_replace(digest, "[a-f]", "")
    cut = lambda text, tag, low, high: F.substr(text, F.lit(1), F.lit(low) + draw(tag, high - low + 1))
    join = lambda by: F.concat_ws(by, word("a"), word("b"), F.when(draw("c", 3) > 0, word("c")), F.when(draw("d", 3) > 0, word("d")))
    number = draw("n", 2000).cast("string")
    around = F.regexp_replace(F.concat("before", "after"), "[^A-Za-z]", "")  # the place's own letters, run together
    prose = F.when(F.length(around) >= 16, cut(around, "len", 16, 40)).otherwise(join(""))
    made = [
        # secrets
        cut(digest, "len", 16, 64), F.upper(cut(digest, "len", 16, 64)), cut(code, "len", 20, 64), cut(plain, "len", 16, 48), F.upper(F.concat(F.lit("AK"), cut(plain, "len", 14, 20))),
        F.concat(cut(plain, "len", 3, 6), one_of("mark", ["!", "@", "$", ".", "#", "%"]), F.substr(plain, F.lit(20), F.lit(2) + draw("tail", 6)), F.substr(digits, F.lit(1), F.lit(1) + draw("digits", 3))),
        # no secrets
        join("_"), F.concat(join("-"), F.lit("-"), number), F.concat(join("/"), F.lit("/"), F.when(draw("hex", 2) > 0, cut(digest, "len", 8, 32)).otherwise(number), F.lit("/"), word("e")),
        F.repeat(one_of("ruler", ["=", "-", "_", "x", "0", "-="]), F.lit(8) + draw("len", 40)), F.when(draw("date", 2) > 0, cut(digits, "len", 8, 40)).otherwise(F.concat(F.lit("20"), F.substr(digits, F.lit(1), F.lit(2)), F.lit("-0"), draw("m", 9).cast("string"), F.lit("-"), F.substr(digits, F.lit(5), F.lit(2)))),
        F.when(draw("camel", 2) > 0, F.concat(F.initcap(word("a")), F.initcap(word("b")), F.initcap(word("c")), F.when(draw("num", 2) > 0, number).otherwise("")))
        .otherwise(F.when(draw("upper", 2) > 0, F.upper(prose)).otherwise(prose)),
    ]
    value = F.element_at(F.array(*made), F.col("kind") + 1)
    rows = rows.withColumn("sign", F.when((draw("told", 2) == 0) | (F.col("kind") == 5), one_of("sign", SIGNS)))  # a short password is found by its name alone
    close = F.coalesce(F.regexp_extract("sign", "[\"']$", 0), F.lit(""))
    before = F.when(F.col("sign").isNotNull(), F.concat(F.right("before", F.lit(20)), F.lit(" "), one_of("name", NAMES), "sign")).otherwise(F.regexp_replace("before", KEYWORDS, "word"))
    return rows.select(value.alias("value"), before.alias("before"), F.concat(close, F.col("after")).alias("after"), (F.col("kind") < KINDS // 2).cast("int").alias("label"))


def fit(labelled: DataFrame, most: int = MOST_LABELLED):
    """A forest fitted on at most ``most`` labelled findings (FEATURES, label 0/1), half of each label at most, drawn by hash of
    the value; None if one label is missing."""
    rows = labelled.filter("label is not null").select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64("value", "before").alias("h"))
    half = most // 2
    sample = rows.filter("label = 1").orderBy("h", *FEATURES).limit(half).unionByName(rows.filter("label = 0").orderBy("h", *FEATURES).limit(half))
    sample = sample.coalesce(1).cache()
    try:
        if sample.select("label").distinct().count() < 2:
            return None
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
        return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))
    finally:
        sample.unpersist()


def _scored(found: DataFrame, model) -> DataFrame:
    done = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    return done.withColumn("score", F.element_at(vector_to_array("probability"), 2))


def held_out_figures(docs: DataFrame, most: int = MOST_LABELLED) -> tuple[float, float]:
    """(precision, recall) on the fifth of the planted findings, by hash of the value, that a forest fitted on the rest has not seen."""
    found, words = written(candidates(docs), "candidates"), dictionary(docs)
    rows = featured(planted(found, words, most), words).withColumn("fold", F.pmod(F.xxhash64("value"), F.lit(5)))
    rows = written(rows, "planted")
    got = _scored(rows.filter("fold = 0"), fit(rows.filter("fold > 0"), most)).withColumn("said", F.col("score") >= 0.5)
    hit, said, all_ = got.agg(F.count_if(F.col("said") & (F.col("label") == 1)), F.count_if("said"), F.sum("label")).first()
    return hit / max(said, 1), hit / max(all_, 1)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, k1, nth, start, value, before, after, score, secret) of every candidate of docs (doc_id, text).

    labelled: findings (value, before, after, label 0/1); without it, or if it lacks one label, planted ones are learned from.
    secret: score >= 0.5.  Columns of docs but those two are not read.  Repeated rows give their findings each; null or
    empty texts and empty tables give none.  The candidates are written once to the shared folder.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found, words = written(candidates(docs), "candidates"), dictionary(docs)
    model = fit(featured(labelled.select("value", "before", "after", "label"), words)) if labelled is not None else None
    model = model or fit(featured(planted(found, words), words))
    done = found.withColumn("score", F.lit(0.0)) if model is None else _scored(featured(found, words), model)  # None: there is no candidate
    return done.select("doc_id", "k1", "nth", "start", "value", "before", "after", "score", (F.col("score") >= 0.5).alias("secret"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the span of every secret replaced by ``mark``; all else in its texts, other rows and columns are untouched, whatever
    the columns' names are."""
    found = scan(docs).filter("secret").groupBy(F.col("k1").alias("key")).agg(F.array_sort(F.collect_set("nth")).alias("gone"))

    def marked(p: Column, m: Column, gone: Column) -> Column:
        between = lambda a, n: F.array_join(F.zip_with(F.slice(p, a + 1, n), F.slice(m, a + 1, n), lambda x, y: F.concat(x, y)), "")
        since = lambda i: F.coalesce(F.get(gone, i - 1), F.lit(-1)) + 1
        heads = F.transform(gone, lambda at, i: F.concat(between(since(i), at - since(i)), F.get(p, at), _name(F.get(m, at)), F.lit(mark)))
        last = F.element_at(gone, -1) + 1
        return F.concat(F.array_join(heads, ""), between(last, F.size(m) - last), F.element_at(p, -1))

    text = F.col("row.text")
    pieces, finds = _pieces(text.cast("string"))
    clean = _let(pieces, lambda p: _let(finds, lambda m: marked(p, m, F.col("gone"))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.withColumn("key", F.xxhash64("row.doc_id", text.cast("string"))).join(found, "key", "left")
    return joined.select(*((F.when(F.col("gone").isNotNull(), clean).otherwise(text) if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
