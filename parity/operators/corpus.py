"""Analytics over corpora of query pairs and experiment records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import laid_out, numbered, with_sums
from .scratch import written

POINTS = "array<struct<point:string,num:bigint>>"


def names_of(points: Column) -> Column:
    return F.transform(points, lambda p: p["point"])


def pending_work(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done, list(keys), "left_anti")


def append_new(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """base and the records of extra whose text is not there yet (one of equal texts); joined on a hash, then on the text."""
    h = F.xxhash64(key).alias("__h")
    known = base.select(h, F.col(key).alias("__known"))
    one = extra.dropDuplicates([key]).withColumn("__h", F.xxhash64(key))
    fresh = one.join(known, (one["__h"] == known["__h"]) & (one[key] == known["__known"]), "left_anti").drop("__h")
    return base.unionByName(fresh)


def pairs_within_points(pairs: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Pairs all of whose points are allowed; a pair without points passes."""
    return pairs.filter(F.size(F.array_except(names_of(F.col("points")), F.array(*map(F.lit, allowed)))) == 0)


def pairs_using_table(pairs: DataFrame, table: str) -> DataFrame:
    return pairs.filter(F.array_contains("tables", table))


def pairs_matching_clauses(pairs: DataFrame, features: Mapping[str, Column], need: Sequence[str]) -> DataFrame:
    """Pairs whose text has the needed clauses; a GROUP BY that is not needed rejects."""
    keep = F.lit(True)
    for c in need:
        f = features[c]
        keep = keep & (f if c.startswith("has_") else f > 0)
    return pairs.filter(keep if "has_group_by" in need else keep & ~features["has_group_by"])


def pairs_tables_agree(pairs: DataFrame, src: str = "src_tables", tgt: str = "tgt_tables") -> DataFrame:
    """Pairs whose table sets are equal, as ``tables``; an unknown side takes the other's, both unknown drops the pair."""
    a, b = F.array_sort(F.array_distinct(src)), F.array_sort(F.array_distinct(tgt))
    return pairs.withColumn("tables", F.coalesce(a, b)).filter(F.col("tables").isNotNull() & (F.coalesce(a, b) == F.coalesce(b, a)))


def pairs_fulfilling(pairs: DataFrame, required: Sequence[tuple[str, int]], min_total: int) -> DataFrame:
    """Pairs holding every required (point, num) and at least min_total points in all."""
    has = F.lit(True)
    for point, num in required:
        has = has & F.array_contains("points", F.struct(F.lit(point).alias("point"), F.lit(num).cast("long").alias("num")))
    return pairs.filter(has & (F.aggregate("points", F.lit(0).cast("long"), lambda acc, p: acc + p["num"]) >= min_total))


def merge_point_counts(pairs: DataFrame, key: str) -> DataFrame:
    """One list per key: counts of equal points added, sorted by point."""
    summed = pairs.select(key, F.explode("points").alias("p")).groupBy(key, F.col("p.point").alias("point")).agg(F.sum("p.num").alias("num"))
    return summed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("point", "num"))).alias("points"))


def distinct_point_combos(pairs: DataFrame) -> DataFrame:
    """(direction, combos): distinct multisets of points per direction, order-blind, and in total (direction null)."""
    canon = F.to_json(F.array_sort("points"))
    return pairs.select("direction", canon.alias("combo")).rollup("direction").agg(F.countDistinct("combo").alias("combos"))


def _shares() -> list[Column]:
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return [F.count("*").alias("n"), share("executable").alias("acc_ex"), share("equal").alias("acc_res")]


def accuracy_cube(results: DataFrame) -> DataFrame:
    """Acc_EX and Acc_RES per translator and direction with all totals (null stands for all)."""
    return results.cube("translator", "direction").agg(*_shares())


def accuracy_by_category(results: DataFrame, rules: DataFrame) -> DataFrame:
    """The same per category of the rules that a record's points use (each category once a record)."""
    used = results.select("record_id", "translator", "executable", "equal", F.explode("points").alias("point"))
    kinds = used.join(rules.select("point", "category"), "point").select("record_id", "translator", "executable", "equal", "category").distinct()
    return kinds.groupBy("translator", "category").agg(*_shares())


def accuracy_by_bucket(results: DataFrame, value: str, edges: Sequence[int]) -> DataFrame:
    """The same per bucket of a value; a bucket is named by its lower edge, values below the first edge are left out."""
    bucket = F.lit(None).cast("int")
    for e in edges:
        bucket = F.when(F.col(value) >= e, F.lit(e)).otherwise(bucket)
    return results.withColumn("bucket", bucket).filter("bucket is not null").groupBy("translator", "bucket").agg(*_shares())


def accuracy_delta(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sets summarised under keys, side by side, and acc_res of b minus that of a."""
    side = lambda df, n: df.groupBy(*keys).agg(*(c.alias(f"{name}_{n}") for c, name in zip(_shares(), ("n", "acc_ex", "acc_res"), strict=True)))
    both = side(a, "a").join(side(b, "b"), list(keys), "full")
    return both.withColumn("delta", F.round(F.col("acc_res_b") - F.col("acc_res_a"), 6))


def graded_score(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """1 for an equal result, 0.2 if it runs, 0 else, averaged."""
    grade = F.when(F.col("equal"), 1.0).when(F.col("executable"), 0.2).otherwise(0.0)
    return results.groupBy(*by).agg(F.round(F.avg(grade), 6).alias("score"))


def coverage(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """(point, covered) of every marked point."""
    used = pairs.select(F.explode(names_of(F.col("points"))).alias("point")).distinct().withColumn("covered", F.lit(True))
    return marked.select("point").distinct().join(used, "point", "left").select("point", F.coalesce("covered", F.lit(False)).alias("covered"))


def corpus_stats(pairs: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Number of pairs for each ``by``, and mean, least, greatest and exact median of each value; nulls count for none of them."""
    stats = []
    for v in values:
        stats += [F.round(F.avg(v), 6).alias(f"{v}_avg"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    out = pairs.groupBy(F.struct(*by).alias("__by")).agg(F.count("*").alias("n"), *stats)
    for v in values:
        out = out.join(medians(pairs, by, v), "__by", "left")
    return out.select(*(F.col("__by")[c].alias(c) for c in by), "n", *(f"{v}_{s}" for v in values for s in ("avg", "min", "max", "mid")))


def medians(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(__by, value_mid): the exact median of a number for each ``by``, half-way between the two middle ones of an even number.

    Equal values are counted first; the counts are sorted in ranges and summed up to each, so that neither a group of a third of all rows nor its
    different values are one task's work.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("__by"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    laid = laid_out(counts, "__by", "v")
    placed = with_sums(laid, key="__by", before=F.col("n")).join(laid.groupBy("__by").agg(F.sum("n").alias("total")), "__by")
    at = lambda nth: F.max(F.when((F.col("before") <= nth) & (nth < F.col("before") + F.col("n")), F.col("v")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return placed.groupBy("__by").agg(((at(low) + at(high)) / 2).alias(f"{value}_mid"))


def verdict_breakdown(results: DataFrame, reason: Column, by: Sequence[str]) -> DataFrame:
    return results.withColumn("reason", reason).groupBy(*by, "reason").agg(F.count("*").alias("n"))


def quota_bounds(weights: DataFrame, order: str, weight: str, n: int) -> DataFrame:
    """weights (a table of strata) with the upper bound of each one's share of n samples."""
    upto = F.sum(weight).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy())
    return weights.withColumn("upper", F.round(upto / total * n).cast("long"))


#: Fixed value: what stands for a query without a well-formed attempt.
FAILED = "Translation failed"


def last_good_attempt(history: DataFrame, key: str, attempt: str, answer: str, good: Column) -> DataFrame:
    """Per query the answer of the last attempt in the right form, else the fixed failure text."""
    best = F.max(F.when(good, F.struct(F.col(attempt), F.col(answer).alias("answer")))).alias("best")
    return history.groupBy(key).agg(best).select(key, F.coalesce("best.answer", F.lit(FAILED)).alias("answer"))


def dedupe_ranked(hits: DataFrame, query: str, key: str, rank: Sequence[str]) -> DataFrame:
    """Each key once a query, the best rank first."""
    w = Window.partitionBy(query, key).orderBy(*rank)
    return hits.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def rank_relevance(pairs: DataFrame, used: Sequence[str], linked: Sequence[str], covered: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """pairs with fresh, used and linked, the keys to sort by (all descending, then pair_id): points not covered, tables used already
    and tables linked with those."""
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    names = F.array_distinct(names_of(F.col("points")))
    size = lambda a, b: F.size(F.array_intersect(a, b))
    linked = sorted(set(linked) - set(used))
    return pairs.select("pair_id", F.size(F.array_except(names, arr(covered))).alias("fresh"), size(F.col("tables"), arr(used)).alias("used"), size(F.col("tables"), arr(linked)).alias("linked"), *keep)


def points_in_common(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair_id, points) with only the wanted points, pairs without any left out."""
    names = pairs.select("pair_id", F.explode(F.array_distinct(names_of(F.col("points")))).alias("point"))
    return names.join(wanted.select("point").distinct(), "point", "left_semi").groupBy("pair_id").agg(F.array_sort(F.collect_set("point")).alias("points"))


CANDIDATES = 1000  # pairs that a round of greedy_cover looks at on the driver


def greedy_cover(pairs: DataFrame, wanted: DataFrame, links: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(step, pair_id, fresh): a small set of pairs that covers every coverable wanted point.

    Each step takes the pair with the most new points, of equals the most tables in use, then the most tables linked with
    those (``links`` by table), then the smallest id.  pairs: (pair_id, points, tables), ids distinct; null points and tables are none.

    The result is that of one step after another, in fewer rounds.  A round looks at the best thousand pairs: while one of them has
    more new points than any pair outside can have, it is taken on the driver, since new points only get fewer.  Where a thousand or more
    have equally many, the round is one of reservations in Spark: every tied pair whose new points no tied pair before it shares is taken at once,
    up to the first that brings a new table into use, which changes the order.  So there are about as many rounds as tables, numbers of new
    points and lengths of chains of sharing pairs.  Points that are still new and the pairs taken are tables in the shared folder; the driver
    holds tables in use and a thousand pairs.
    """
    links, spark = links or {}, pairs.sparkSession
    names = pairs.select("pair_id", F.coalesce("tables", F.array()).alias("tables"), F.explode(F.array_distinct(names_of(F.col("points")))).alias("point"))
    names = names.join(wanted.select("point").distinct(), "point", "left_semi")
    left = written(names.groupBy("pair_id").agg(F.sort_array(F.collect_set("point")).alias("names"), F.first("tables").alias("tables")), "cover")
    kind, arr = dict(pairs.dtypes)["pair_id"], lambda xs: F.array(*map(F.lit, sorted(xs))).cast("array<string>")
    schema = f"epoch long, used int, linked int, pair_id {kind}, fresh long"
    used, taken, epoch, level = set(), [], 0, None
    while True:
        near = {t for u in used for t in links.get(u, ())} - used
        ranked = left.withColumns({"fresh": F.size("names"), "used": F.size(F.array_intersect("tables", arr(used))), "linked": F.size(F.array_intersect("tables", arr(near)))})
        best = ranked.orderBy(F.desc("fresh"), F.desc("used"), F.desc("linked"), "pair_id").limit(CANDIDATES).collect()
        if not best:
            break
        most = best[0]["fresh"]
        epoch, level = epoch + (level != most), most
        if len(best) == CANDIDATES and best[-1]["fresh"] == most:
            got = written(_reserved(ranked.filter(F.col("fresh") == most), used).withColumn("epoch", F.lit(epoch).cast("long")), "cover")
            points = got.select(F.explode("names").alias("point"))
            left = _without(left, points)
            more = {r[0] for r in got.select(F.explode("tables")).distinct().collect()} - used
            taken.append(got.select("epoch", "used", "linked", "pair_id", F.col("fresh").cast("long").alias("fresh")))
            used, epoch = used | more, epoch + bool(more)
            continue
        outside, pool, first, covered, rows = (best[-1]["fresh"] if len(best) == CANDIDATES else 0), {r["pair_id"]: r for r in best}, True, set(), []
        while pool:
            near = {t for u in used for t in links.get(u, ())} - used
            key = lambda r: (len(set(r["names"]) - covered), len(set(r["tables"]) & used), len(set(r["tables"]) & near))  # noqa: B023, E731
            top = min(pool.values(), key=lambda r: (*(-x for x in key(r)), r["pair_id"]))
            fresh, *rank = key(top)
            if not fresh or not (first or fresh > outside):
                break
            epoch, level = epoch + (level != fresh), fresh
            rows.append((epoch, *rank, top["pair_id"], fresh))
            covered |= set(top["names"])
            epoch, used = epoch + bool(set(top["tables"]) - used), used | set(top["tables"])
            del pool[top["pair_id"]]
            first = False
        taken.append(spark.createDataFrame(rows, schema))
        one = spark.createDataFrame([(sorted(covered),)], "gone array<string>")  # of a thousand pairs at most
        left = written(left.crossJoin(F.broadcast(one)).select("pair_id", F.array_except("names", "gone").alias("names"), "tables").filter(F.size("names") > 0), "cover")
    done = spark.createDataFrame([], schema)
    for part in taken:
        done = done.unionAll(part)
    return numbered(done, "epoch", F.desc("used"), F.desc("linked"), "pair_id", name="step").select(F.col("step").cast("int").alias("step"), "pair_id", "fresh")


def _reserved(tied: DataFrame, used: set[str]) -> DataFrame:
    """Of pairs with equally many new points, those that one step after another would take whatever becomes of the others: no pair before
    them shares a point; if one brings new tables, all before it are decided and none after it is taken."""
    order = F.struct((-F.col("used")).alias("u"), (-F.col("linked")).alias("l"), F.col("pair_id").alias("id"))
    points = tied.select(order.alias("o"), F.explode("names").alias("point"))
    first = points.groupBy("point").agg(F.min("o").alias("first"))
    lost = points.join(first, "point").groupBy(F.col("o.id").alias("pair_id")).agg(F.max(F.col("first") < F.col("o")).alias("lost"))
    fresh_table = F.size(F.array_except("tables", F.array(*map(F.lit, sorted(used))).cast("array<string>"))) > 0
    seen = written(tied.join(lost, "pair_id").withColumns({"o": order, "brings": fresh_table}), "cover")
    ends = seen.agg(F.min(F.when(F.col("lost"), F.col("o"))).alias("open"), F.min(F.when(~F.col("lost") & F.col("brings"), F.col("o"))).alias("brings"))
    before = F.col("end.brings").isNull() | (F.col("o") < F.col("end.brings"))
    itself = (F.col("o") == F.col("end.brings")) & (F.col("end.open").isNull() | (F.col("end.brings") < F.col("end.open")))
    both = seen.filter(~F.col("lost")).crossJoin(F.broadcast(ends.select(F.struct("open", "brings").alias("end"))))
    return both.filter(before | F.coalesce(itself, F.lit(False))).select("pair_id", "names", "tables", "fresh", "used", "linked")


def _without(left: DataFrame, points: DataFrame) -> DataFrame:
    """left without points that are covered now."""
    rest = left.select("pair_id", "tables", F.explode("names").alias("point")).join(points.distinct(), "point", "left_anti")
    return written(rest.groupBy("pair_id").agg(F.sort_array(F.collect_set("point")).alias("names"), F.first("tables").alias("tables")), "cover")


def _drawn(seed: int, *keys: Column | str) -> Column:
    """A hash in hexadecimal that another engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


SORTED_AT_ONCE = 10_000  # rows of the boundary bin that are sorted in one place


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, the same under any partitioning: those with the smallest hashes of (seed, key), ties by key.

    Rows are counted by the first four digits of their hash (at most 65,536 counts reach the driver).  Rows below the bin in which the nth lies
    are taken by a filter; the bin is counted again by its next digits until so few rows are left that they can be sorted in one
    place.  So a sample of half the rows shuffles counts and one bin.
    """
    h, low, left = _drawn(seed, key), "", n
    while True:
        digits = len(low) + 4
        bins = df.filter(h.startswith(low)).groupBy(F.substring(h, 1, digits).alias("bin")).count().collect()
        nth = None
        for name, count in sorted(bins):
            if count >= left:
                nth = (name, count)
                break
            left -= count
        if nth is None:
            return df  # fewer rows than n
        low = nth[0]
        if nth[1] <= SORTED_AT_ONCE or digits >= 32:
            break
    edge = df.filter(h.startswith(low)).orderBy(h, key).limit(left)
    return df.filter(F.substring(h, 1, len(low)) < low).unionAll(edge)


def seeded_split(df: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """df with ``part``: train for a share of the keys, dev for the rest."""
    bound = f"{round(share * 16**4) - 1:04x}"
    return df.withColumn("part", F.when(F.substring(_drawn(seed, key), 1, 4) <= bound, "train").otherwise("dev"))


def _uniform(seed: int, *keys: Column | str) -> Column:
    return F.conv(F.substring(_drawn(seed, *keys), 1, 8), 16, 10).cast("double") / float(16**8)


def draw_point_lists(rules: DataFrame, n: int, strata: DataFrame, directions: Sequence[tuple[str, float]], seed: int) -> DataFrame:
    """(sample_id, direction, stratum, points) of n samples: stratum by quota, direction by weight, a number of draws uniform in [low, high], rules
    drawn with replacement, repeats counted.

    rules (direction, point); strata (stratum, low, high, weight).
    """
    bounds = quota_bounds(strata, "stratum", "weight", n)
    bounds = bounds.withColumn("lower", F.coalesce(F.lag("upper").over(Window.orderBy("stratum")), F.lit(0)))
    spark = rules.sparkSession
    samples = spark.range(n).withColumnRenamed("id", "sample_id")
    samples = samples.join(F.broadcast(bounds), (F.col("sample_id") >= F.col("lower")) & (F.col("sample_id") < F.col("upper")))  # a table of strata
    total, upto, pick = sum(w for _, w in directions), 0.0, F.lit(directions[-1][0])
    for name, w in reversed(directions[:-1]):
        upto = sum(x for d, x in directions[: [d for d, _ in directions].index(name) + 1]) / total
        pick = F.when(_uniform(seed, F.lit("dir"), "sample_id") < upto, F.lit(name)).otherwise(pick)
    many = F.col("low") + F.floor(_uniform(seed, F.lit("many"), "sample_id") * (F.col("high") - F.col("low") + 1)).cast("int")
    draws = samples.withColumn("direction", pick).withColumn("draw", F.explode(F.sequence(F.lit(1), many)))
    ranked = rules.withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy("point")) - 1)
    sizes = rules.groupBy("direction").agg(F.count("*").alias("size"))
    draws = draws.join(F.broadcast(sizes), "direction").withColumn("rank", F.floor(_uniform(seed, F.lit("rule"), "sample_id", "draw") * F.col("size")).cast("int"))
    got = draws.join(ranked, ["direction", "rank"]).groupBy("sample_id", "direction", "stratum", "point").agg(F.count("*").alias("num"))
    return got.groupBy("sample_id", "direction", "stratum").agg(F.array_sort(F.collect_list(F.struct("point", "num"))).alias("points"))
