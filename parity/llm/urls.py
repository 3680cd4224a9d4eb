"""URL filter: host and path rules first, then a character language-model ratio.

URLs that a rule allows or blocks are the accepted and rejected training sets.  Both sets get a smoothed
variable-order Markov model (orders 3 to 0, Witten-Bell back-off) over 40 character classes; a URL that no rule
decides is judged by the length-normalised log-likelihood difference against a threshold calibrated on a fold of
rule-decided URLs that the models did not see.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, with_fields

SYMBOLS = 40  # boundary, a-z, digit, eleven marks, other
MARKS = b"/.-_?=&#:%+"
ORDER = 3
CELLS = SYMBOLS ** (ORDER + 1)  # the proven bound of a model: 2.56 million cells a class, 10 MB when broadcast
CALIBRATION_FOLDS = 5  # one of them calibrates, the others train
BIN = 0.01

CLASS_OF = np.full(256, SYMBOLS - 1, dtype=np.int64)
CLASS_OF[97:123] = np.arange(1, 27)
CLASS_OF[65:91] = np.arange(1, 27)
CLASS_OF[48:58] = 27
for _i, _b in enumerate(MARKS):
    CLASS_OF[_b] = 28 + _i


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls.  rules: (verdict, host, path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends up outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(word)).otherwise(verdict)
    return name, verdict


def gram_codes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all (ORDER + 1)-grams of each text, padded by boundaries, and the number of the first of each text."""
    n = len(offs) - 1
    lens = np.diff(offs)
    at = offs[:-1] + (ORDER + 1) * np.arange(n)
    seq = np.zeros(len(buf) + (ORDER + 1) * n + ORDER, dtype=np.int64)
    inside = np.repeat(at + ORDER - offs[:-1], lens) + np.arange(len(buf))
    seq[inside] = CLASS_OF[buf]
    ends = np.cumsum(lens + 1)
    first = np.concatenate([[0], ends])
    pos = np.repeat(at - first[:-1], lens + 1) + np.arange(first[-1])
    code = np.zeros(len(pos), dtype=np.int64)
    for i in range(ORDER + 1):
        code = code * SYMBOLS + seq[pos + i]
    return code, first


def _witten_bell(counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Probabilities of the cells: order k falls back on order k - 1 with the weight of the different symbols that ``seen`` has after
    the context, the last order on all symbols alike."""
    shape = (SYMBOLS,) * (ORDER + 1)
    c, known = counts.reshape(shape).astype(np.float64), seen.reshape(shape)
    prob = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for k in range(ORDER + 1):
        outer = tuple(range(ORDER - k))
        own = c.sum(axis=outer)
        kinds = (known.sum(axis=outer) > 0).sum(-1, keepdims=True)
        prob = np.where(kinds > 0, (own + kinds * prob) / np.maximum(own.sum(-1, keepdims=True) + kinds, 1), prob)
    return prob.reshape(-1)


def log_ratio(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each cell.  Both sets weigh the same and share their fall-back weights: else the larger one would
    give less to what neither has seen, and a url from elsewhere would count against it."""
    both = (accepted.sum() + rejected.sum()) / 2
    models = [_witten_bell(c * (both / c.sum()), accepted + rejected) for c in (accepted, rejected)]
    return (np.log(models[0]) - np.log(models[1])).astype(np.float32)


class RatioModel:
    """Log-likelihood ratios of the cells, and the calibrated threshold."""

    def __init__(self, ratio: np.ndarray, threshold: float) -> None:
        self.ratio, self.threshold = ratio, threshold


def _scored(df: DataFrame, ratio: np.ndarray, text: str) -> DataFrame:
    """df with a score column: mean log ratio of its text's grams."""
    shared = df.sparkSession.sparkContext.broadcast(ratio)
    schema = with_fields(df, ("score", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, buf, offs in text_slices(batch.column(text)):
                codes, first = gram_codes(buf, offs)
                out[a:b] = np.add.reduceat(shared.value[codes].astype(np.float64), first[:-1]) / np.diff(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return df.mapInArrow(run, schema)


def train(labelled: DataFrame) -> RatioModel:
    """labelled: (text, accepted boolean).  All rows count; without both kinds every URL is allowed."""
    spark = labelled.sparkSession
    labelled = labelled.withColumn("fold", F.pmod(F.crc32(F.encode("text", "utf-8")), F.lit(CALIBRATION_FOLDS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS), dtype=np.int64)
        for batch in batches:
            accepted = np.asarray(batch.column("accepted")).astype(np.int64)
            for a, b, buf, offs in text_slices(batch.column("text")):
                codes, first = gram_codes(buf, offs)
                kind = np.repeat(accepted[a:b], np.diff(first))
                for k in (0, 1):
                    cell, n = np.unique(codes[kind == k], return_counts=True)
                    sums[k, cell] += n
        kind, cell = np.nonzero(sums)
        for i in range(0, len(cell), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(kind[s]), pa.array(cell[s]), pa.array(sums[kind[s], cell[s]])], names=["kind", "cell", "n"])

    train_rows = labelled.filter("fold <> 0").select("text", "accepted")
    counts = train_rows.mapInArrow(count, "kind long, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros((2, CELLS), dtype=np.int64)
    dense[counts["kind"], counts["cell"]] = counts["n"]
    if not dense.any(axis=1).all():
        return RatioModel(np.zeros(CELLS, dtype=np.float32), float("-inf"))
    ratio = log_ratio(dense[1], dense[0])
    held = _scored(labelled.filter("fold = 0").select("text", "accepted"), ratio, "text")
    bins = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) / BIN).cast("long")
    hist = held.groupBy("accepted", bins.alias("bin")).count().toPandas()
    return RatioModel(ratio, _threshold(hist))


def _threshold(hist) -> float:
    """The cut with the best balanced accuracy on the calibration fold; of equals, the one nearest zero."""
    pos, neg = hist[hist["accepted"]], hist[~hist["accepted"]]
    if pos.empty or neg.empty:
        return 0.0
    cuts = np.unique(np.concatenate([hist["bin"], hist["bin"] + 1, [0]]))
    kept = np.array([pos["count"][pos["bin"] >= c].sum() / pos["count"].sum() for c in cuts])
    gone = np.array([neg["count"][neg["bin"] < c].sum() / neg["count"].sum() for c in cuts])
    good = kept + gone
    return float(min(cuts[good >= good.max() - 1e-12], key=abs)) * BIN


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row, repeated rows and null urls included.

    Null, empty or scheme-less urls have empty host and path and fit no rule; the method judges their text.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("text"))
    host, path = host_and_path(F.col("text"))
    base = base.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("by_rule", verdict)
    model = train(base.filter("by_rule is not null").select("text", (F.col("by_rule") == "allow").alias("accepted")))
    scored = _scored(base, model.ratio, "text")
    own = F.when(F.col("score") >= F.lit(model.threshold), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "score")
