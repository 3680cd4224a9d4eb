"""Greedy packing of rows in order into statements of bounded length, the same under any partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import whole_keys
from .numbering import laid_out, with_sums
from .scratch import written

BLOCK = 1 << 16  # rows whose statements are followed at once


def _next(start: np.ndarray, end: np.ndarray, room: int, most: int) -> np.ndarray:
    """For each row as the first of a statement, the row after its last: rows while their ends (with separators) fit, at least one and ``most`` at most."""
    at = np.arange(len(start))
    return np.minimum(np.maximum(np.searchsorted(end, start + room, side="right"), at + 1), at + most)


def packed(rows: DataFrame, column: str, order: list, room: int, most: int) -> DataFrame:
    """(start, n, rows): statements in which the texts of ``column``, each with its separator of two characters, take at most ``room`` characters and
    ``most`` rows; a longer row is alone.  rows is the list of texts in order (ties by the text), start the number of its first row.

    Lengths are summed over sorted ranges, so that a row knows where a statement that begins with it would end.  Blocks of rows are followed from
    every row with which a statement from the block before may go on; which of those is real is found by pointer jumping from block to block, and then
    each block's statements are followed alone.  A statement's rows are gathered as such, bounded by ``room`` and ``most``.
    """
    laid = laid_out(rows.select(*rows.columns), *order, column)
    size = F.length(column) + 2
    placed = with_sums(laid, i=F.lit(1), start=size).select("i", "start", size.cast("long").alias("size"), F.col(column).alias("row"))
    width = max(BLOCK, most)
    block = F.floor(F.col("i") / width)
    halo = F.when((F.col("i") % width < most) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    numbers = written(placed.select("i", "start", "size"), "lengths")
    spread = numbers.select(F.explode(halo).alias("key"), "i", "start", "size")

    def arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(numbers of the rows, next row of each, rows of the block itself) of each block in a batch."""
        keys, i, start, size = (np.asarray(batch.column(c)) for c in ("key", "i", "start", "size"))
        cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            yield i[a:b], _next(start[a:b], start[a:b] + size[a:b], room, most), int((i[a:b] // width == keys[a]).sum()), a

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches):
            came, went = [], []
            for i, after, own, _ in arrays(batch):
                to = after.copy()
                for s in range(own - 1, -1, -1):
                    if after[s] < own:
                        to[s] = to[after[s]]
                first = min(most, own)
                came.append(i[:first])
                went.append(i[0] + to[:first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(came)), pa.array(np.concatenate(went))], names=["i", "to"])

    by_block = spread.repartition("key").sortWithinPartitions("key", "i")
    jumps = written(by_block.mapInArrow(exits, "i long, to long"), "jumps")
    real = written(jumps.filter("i = 0").select("i"), "starts")
    while True:
        further = real.join(jumps, "i").select(F.col("to").alias("i")).join(jumps.select("i"), "i", "left_semi")
        if further.isEmpty():
            break
        real = written(real.unionByName(further).distinct(), "starts")
        jumps = written(jumps.join(jumps.toDF("to", "next"), "to").select("i", F.col("next").alias("to")).unionByName(jumps.join(jumps.select(F.col("i").alias("to")), "to", "left_anti").select("i", "to")), "jumps")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches):
            starts, many = [], []
            flags = np.asarray(batch.column("real"))
            for i, after, own, a in arrays(batch):
                found = np.flatnonzero(flags[a : a + own])
                s = int(found[0]) if len(found) else own
                while s < own:
                    starts.append(int(i[s]))
                    many.append(int(min(after[s], len(i)) - s))
                    s = int(after[s])
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(many, pa.int64())], names=["first", "n"])

    flagged = spread.join(real.withColumn("real", F.lit(True)), "i", "left").select("key", "i", "start", "size", F.coalesce("real", F.lit(False)).alias("real"))
    found = flagged.repartition("key").sortWithinPartitions("key", "i").mapInArrow(follow, "first long, n long")
    members = found.select("first", "n", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("i"))
    joined = members.join(placed.select("i", "row"), "i").groupBy("first", "n").agg(F.sort_array(F.collect_list(F.struct("i", "row"))).alias("rows"))
    return joined.select(F.col("first").alias("start"), "n", F.transform("rows", lambda r: r["row"]).alias("rows"))
