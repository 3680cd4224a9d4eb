"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals.

A window can only repeat if its anchor does: the window's smallest hash over runs of ``GRAM`` words.  Anchors are few
(about two for every ``window - GRAM`` words), so they are counted first; only windows whose anchor occurs twice
are hashed, shuffled and counted.  Nothing is lost: equal windows have equal anchors.

Windows are told apart by two independent hashes, 128 bits together: among 10^13 windows the odds of any
two different ones sharing both are 1 to 10^12.  Counts are summed before they are shuffled, and the windows of an anchor that very many
documents hold are counted in salted groups first, so that no key is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHECK_POWERS, parts, signed, text_slices, window_hashes, with_fields, word_hashes, word_spans, written

GRAM = 12
HOT = 1000  # times from which an anchor's windows are counted in salted groups
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, k: int, pick: np.ufunc) -> np.ndarray:
    """pick over every k neighbours, by doubling."""
    done, width = x, 1
    while 2 * width <= k:
        done, width = pick(done[:-width], done[width:]), 2 * width
    return pick(done[: len(x) - k + 1], done[k - width : len(x) - width + 1]) if width < k else done


def _windows(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, second word hashes, gram hashes, anchor of each window, text of each window, first word of each text); a
    window that no text holds whole has text -1."""
    starts, ends, first = word_spans(buf, offs)
    words, checks = word_hashes(buf, starts, ends)
    n = len(words) - k + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return words, checks, none, none, np.zeros(0, np.int64), first
    gram = min(GRAM, k)
    grams = window_hashes(words, gram)
    anchor = _sliding(grams, k - gram + 1, np.minimum)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    text = np.where(text[:n] == text[k - 1 :], text[:n], -1)
    return words, checks, grams, anchor, text, first


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest, k1, k2): rows of equal id and text share a key, and a verdict; rest holds the other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None).cast("int")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    second = F.shiftright(F.xxhash64("text", F.lit(1), "doc_id"), 32).cast("int")
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", second)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, where each run of equal ones starts in it and how long it is."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(fresh)
    return order, first, np.diff(np.append(first, len(order)))


def _anchors(docs: DataFrame, k: int) -> DataFrame:
    """(anchor, k1, k2, times): one row for each document and anchor in it, so that a repetitive document makes no key hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))
            for a, _, buf, offs in text_slices(batch.column("text")):
                _, _, grams, anchor, text, _ = _windows(buf, offs, k)
                if not len(anchor):
                    continue
                width = k - min(GRAM, k) + 1
                inside = np.where(text >= 0, anchor, np.uint64(0))
                pad = np.zeros(width - 1, np.uint64)
                seen = _sliding(np.concatenate([pad, inside, pad]), width, np.maximum)  # over the windows that hold a gram
                at = np.flatnonzero((seen == grams) & (seen > 0))
                # the text of a gram is that of any whole window around it
                owner = _sliding(np.concatenate([np.full(width - 1, -1), text, np.full(width - 1, -1)]), width, np.maximum)[at] + a
                order, first, times = _runs(owner, grams[at])
                key, owner = grams[at][order][first], owner[order][first]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(k1[owner]), pa.array(k2[owner]), pa.array(times)], names=["anchor", "k1", "k2", "times"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "anchor long, k1 long, k2 int, times long")


def _listed(docs: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """(k1, k2, anchors, hot): each document's anchors that occur twice or more, and which of them are hot; and if any is.  The join
    groups nothing, so that Spark splits a hot anchor's rows."""
    counts = written(_anchors(docs, k).groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1"), "anchors")
    found = _anchors(docs, k).select("anchor", "k1", "k2").join(counts, "anchor").groupBy("k1", "k2")
    found = found.agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot"))
    return found, (counts.agg(F.max("n")).first()[0] or 0) > HOT


def _candidates(docs: DataFrame, k: int) -> DataFrame:
    """(window, check, hot, k1, k2, start, more) of the windows whose anchor is in the row's list, one row for each document and window in
    it: where it starts first, and further starts if there are any (mostly null, which keeps the shuffled rows short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))
            lists = {c: (np.asarray(batch.column(c).offsets), np.asarray(batch.column(c).values).view(np.uint64)) for c in ("anchors", "hot")}
            for a, b, buf, offs in text_slices(batch.column("text")):
                words, checks, _, anchor, text, first = _windows(buf, offs, k)
                if not len(anchor):
                    continue
                hit = {c: np.zeros(len(anchor), dtype=bool) for c in lists}
                for c, (ends, flat) in lists.items():
                    for i in range(a, b):
                        if ends[i + 1] > ends[i]:
                            s = slice(first[i - a], max(first[i - a + 1] - k + 1, first[i - a]))
                            hit[c][s] = np.isin(anchor[s], flat[ends[i] : ends[i + 1]])
                at = np.flatnonzero(hit["anchors"] & (text >= 0))
                full, check, owner = window_hashes(words, k)[at], window_hashes(checks, k, CHECK_POWERS)[at], text[at]
                order, head, _ = _runs(owner, full, check)
                start = (at - first[owner]).astype(np.int32)[order]
                one, many = order[head], np.diff(np.append(head, len(order)))
                later = np.ones(len(order), dtype=bool)
                later[head] = False
                more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many - 1)).astype(np.int32)), pa.array(start[later]), mask=pa.array(many == 1))
                cols = [pa.array(signed(full[one])), pa.array(signed(check[one])), pa.array(hit["hot"][at[one]]), pa.array(k1[owner[one] + a]), pa.array(k2[owner[one] + a]), pa.array(start[head]), more]
                yield pa.RecordBatch.from_arrays(cols, names=["window", "check", "hot", "k1", "k2", "start", "more"])

    return docs.mapInArrow(run, "window long, check long, hot boolean, k1 long, k2 int, start int, more array<int>")


def _repeated(rows: DataFrame, some_hot: bool) -> DataFrame:
    """(k1, k2, start, more) of the rows whose window starts more than once.

    A window that is not hot has as many rows as its anchor at most.  A hot one is counted within salts; rows that are
    alone in their salt, one for each salt at most, stay if another salt has the window too.
    """
    times = lambda *by: F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0))).over(Window.partitionBy("window", "check", *by))
    out = rows.filter("not hot").withColumn("n", times()).filter("n > 1").select("k1", "k2", "start", "more")
    if not some_hot:
        return out
    salted = rows.filter("hot").withColumn("salt", F.pmod("k1", F.lit(parts(rows.sparkSession)))).withColumn("n", times("salt"))
    spread = salted.groupBy("window", "check").agg(F.min("salt").alias("x"), F.max("salt").alias("y")).filter("x <> y")
    alone = salted.filter("n = 1").join(spread, ["window", "check"], "left_semi")
    return out.unionByName(salted.filter("n > 1").select("k1", "k2", "start", "more")).unionByName(alone.select("k1", "k2", "start", "more"))


def _cut(docs: DataFrame, k: int) -> DataFrame:
    schema = with_fields(docs.select("doc_id", "rest"), ("n_words", "long"), ("n_removed", "long"), ("removed", "array<struct<from:int,to:int>>"), ("kept", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("starts")
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            ids, rest = batch.column("doc_id"), batch.column("rest")
            for a, b, buf, offs in text_slices(batch.column("text")):
                starts, stops, first = word_spans(buf, offs)
                many = np.diff(first)
                mark = np.zeros(len(starts) + 1, dtype=np.int64)
                at = flat[ends[a] : ends[b]] + np.repeat(first[:-1], np.diff(ends[a : b + 1]))
                np.add.at(mark, at, 1)
                np.add.at(mark, at + k, -1)
                gone = np.cumsum(mark)[:-1] > 0
                text = np.repeat(np.arange(b - a), many)
                edge = np.ones(len(gone), dtype=bool)
                edge[1:] = (gone[1:] != gone[:-1]) | (text[1:] != text[:-1])
                runs = np.flatnonzero(edge)
                run_end = np.append(runs[1:], len(gone))
                take = gone[runs] if len(runs) else np.zeros(0, bool)
                owner = text[runs[take]] if len(runs) else np.zeros(0, np.int64)
                spans = pa.StructArray.from_arrays([pa.array((runs[take] - first[owner]).astype(np.int32)), pa.array((run_end[take] - first[owner]).astype(np.int32))], names=["from", "to"])
                span_offs = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                keep = np.flatnonzero(~gone)
                of = text[keep]
                size = stops[keep] - starts[keep] + 1
                last = np.ones(len(keep), dtype=bool)
                last[:-1] = of[1:] != of[:-1]
                out_at = np.cumsum(size) - size
                src = np.repeat(starts[keep] - out_at, size) + np.arange(int(size.sum()))
                data = np.append(buf, np.uint8(32))[np.minimum(src, len(buf))]
                closing = out_at + size - 1
                data[closing] = 32
                data = np.delete(data, closing[last])
                length = np.bincount(of, weights=size, minlength=b - a).astype(np.int64) - np.bincount(of[last], minlength=b - a)
                out_offs = np.zeros(b - a + 1, dtype=np.int64)
                np.cumsum(length, out=out_offs[1:])
                kept = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(out_offs.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
                removed = np.bincount(text[gone], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), rest.slice(a, b - a), pa.array(many.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.ListArray.from_arrays(pa.array(span_offs), spans), kept],
                    names=["doc_id", "rest", "n_words", "n_removed", "removed", "kept"],
                )

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept, rest) for every row of docs (doc_id, text); rest holds docs' other columns.

    Words are runs without the six ASCII spaces, unchanged.  Every word covered by a window of ``window`` words that
    also starts anywhere else (the same document included) goes; ``removed`` lists the maximal intervals of word
    numbers, ``kept`` is the rest joined by one space.  Null and empty texts have no words; texts shorter than a
    window keep all; repeated rows are copies of each other, so they lose every word a window covers; an empty table gives no rows.
    """
    docs = _keyed(docs)
    listed, some_hot = _listed(docs, window)
    # both joins read the same columns of docs, so that the texts are shuffled once
    rows = _candidates(docs.join(listed, ["k1", "k2"]).select("k1", "k2", "doc_id", "text", "rest", "anchors", "hot"), window)
    starts = _repeated(rows, some_hot).groupBy("k1", "k2").agg(F.concat(F.collect_list("start"), F.flatten(F.collect_list("more"))).alias("starts"))
    joined = docs.join(starts, ["k1", "k2"], "left").select("doc_id", "text", "rest", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    return _cut(joined, window)
