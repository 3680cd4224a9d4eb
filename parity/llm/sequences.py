"""Rows of many sequences put in order in balanced ranges, with their places and chained digests; a sequence may span many ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, signed, with_fields, written

_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_ALL = (1 << 64) - 1


def row_key(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of some texts; their lengths go in, so that no two lists of texts meet."""
    told = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
    return F.substring(F.unhex(F.sha2(F.concat(*told), 256)), 1, 16)


def chain_keys(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digest (two signed longs) of the first ``depth`` rows of a sequence, from their sums."""
    d = depth.astype(np.uint64)
    return signed(mix(a + d * _A)), signed(mix(b ^ mix(d + _B)))


def _runs(batch: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys, which are null, and at which rows another key begins."""
    null = np.asarray(batch.column(key).is_null())
    ids = np.asarray(batch.column(key).fill_null(0))
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return ids, null, fresh


def _within(values: np.ndarray, fresh: np.ndarray, carried) -> tuple[np.ndarray, object]:
    """Running sums that begin anew at every fresh row; ``carried`` is the sum so far of a run that goes on from the batch before."""
    total = np.cumsum(values)
    starts = np.flatnonzero(fresh)
    base = np.concatenate([[values.dtype.type(0) - carried], total[starts] - values[starts]])[np.cumsum(fresh)]
    out = total - base
    return out, out[-1]


def _same(ids: np.ndarray, null: np.ndarray, key: int | None) -> np.ndarray:
    return null if key is None else (ids == key) & ~null


def _laid(df: DataFrame, key: str, by: Sequence[Column], sums, schema, name: str) -> DataFrame:
    """df in sorted ranges, written, with the columns of ``sums`` (batch -> values) summed within each key and range."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, run = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, null, fresh = _runs(batch, key)
            fresh[0] = last != (ids[0], null[0])
            values = sums(batch)
            run = run or [v.dtype.type(0) for v in values]
            got = [_within(v, fresh, c) for v, c in zip(values, run, strict=True)]
            last, run = (ids[-1], null[-1]), [c for _, c in got]
            cols = [*batch.columns, *(pa.array(v.view(np.int64)) for v, _ in got), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))]
            row += n
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).select(*[f.name for f in schema if f.name in df.columns]).mapInArrow(lay, schema), name)


def _before(placed: DataFrame, key: str, sums: Sequence[str]) -> dict[int, tuple]:
    """{range: (its first key, sums of that key in the ranges before)}, where there are any.  The driver sees one row a range."""
    ends = placed.groupBy("__part").agg(F.min_by(F.struct(F.col(key).alias("k")), "__row").alias("first"), F.max_by(F.struct(F.col(key).alias("k"), *sums), "__row").alias("last"))
    out, prev, carried = {}, (), [0] * len(sums)
    for part, first, last in sorted((r["__part"], r["first"]["k"], r["last"]) for r in ends.collect()):
        if prev == (first,):
            out[part] = (first, carried)
        else:
            carried = [0] * len(sums)
        goes_on = prev == (first,) and first == last["k"]
        carried = [last[s] + (c if goes_on else 0) for s, c in zip(sums, carried, strict=True)]
        prev = (last["k"],)
    return out


def _carry(batch: pa.RecordBatch, key: str, before: dict[int, tuple], nth: int, values: np.ndarray) -> np.ndarray:
    ids, null, _ = _runs(batch, key)
    part = np.asarray(batch.column("__part"))
    out = values.copy()
    for p in np.unique(part).tolist():
        if p in before:
            own, sums = before[p]
            out[(part == p) & _same(ids, null, own)] += out.dtype.type(sums[nth] & _ALL)
    return out


def ordered(df: DataFrame, key: str, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """(key, at, *keep): each row's place (from 0) among the rows of its key in the given order.  A null key is a key of its own.

    Rows that the order does not part are dealt by their place in the input, so that not even a third of all rows alike are one range.
    """
    df = df.withColumn("__tie", F.monotonically_increasing_id()).withColumn(key, F.col(key).cast("long"))
    schema = with_fields(df.select(key, *keep), ("__n", "long"), ("__part", "int"), ("__row", "long"))
    placed = _laid(df, key, [F.col(key).asc_nulls_first(), *order, F.col("__tie")], lambda batch: [np.ones(batch.num_rows, np.int64)], schema, "ordered")
    before = _before(placed, key, ["__n"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("__n")).view(np.uint64)
            yield batch.set_column(batch.schema.get_field_index("__n"), "__n", pa.array(signed(_carry(batch, key, before, 0, n))))

    done = placed.mapInArrow(finish, placed.schema) if before else placed
    return done.select(key, (F.col("__n") - 1).alias("at"), *keep)


def chained(df: DataFrame, key: str, digest: str, keep: Sequence[str]) -> DataFrame:
    """(key, at, *keep, k1, k2, p1, p2) of rows (key, at, digest of ``row_key``, *keep) whose places ``at`` are 0, 1, 2 ... for each key:
    the digest of the sequence up to and with the row, and without it.

    Digests are sums modulo 2^64 of hashes of a row and its place, so that ranges are summed apart and then joined.
    """
    base = df.select(F.col(key).cast("long").alias(key), "at", F.col(digest).alias("__digest"), *keep)
    schema = with_fields(base, ("__a", "long"), ("__b", "long"), ("__part", "int"), ("__row", "long"))
    placed = _laid(base, key, [F.col(key), F.col("at")], _steps, schema, "chained")
    before = _before(placed, key, ["__a", "__b"])
    out = with_fields(placed.select(key, "at", *keep), ("k1", "long"), ("k2", "long"), ("p1", "long"), ("p2", "long"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_carry(batch, key, before, i, np.asarray(batch.column(c)).view(np.uint64)) for i, c in enumerate(("__a", "__b")))
            da, db = _steps(batch)
            at = np.asarray(batch.column("at"))
            cols = [batch.column(c) for c in (key, "at", *keep)] + [pa.array(x) for x in (*chain_keys(a, b, at + 1), *chain_keys(a - da, b - db, at))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out])

    return placed.mapInArrow(finish, out)


def _steps(batch: pa.RecordBatch) -> list[np.ndarray]:
    """What each row adds to the two sums: hashes of its digest's halves and its place."""
    halves = np.frombuffer(b"".join(batch.column("__digest").to_pylist()), dtype="<u8").reshape(-1, 2)
    at = np.asarray(batch.column("at")).astype(np.uint64)
    return [mix(mix(halves[:, 0]) + at * _A), mix(mix(halves[:, 1] ^ _B) + at * _B)]
