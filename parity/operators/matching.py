"""Maximum matching of two bags of number vectors within a tolerance."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parity.functions.numbers import is_close

from .numbering import laid_out, with_sums


def near(x: np.ndarray, y: np.ndarray, rel: float, abs_tol: float) -> np.ndarray:
    """Which numbers of y are close to those of x; equal infinities are, NaN is not."""
    with np.errstate(invalid="ignore"):
        within = np.abs(y - x) <= np.maximum(rel * np.maximum(np.abs(x), np.abs(y)), abs_tol)
    return (within & np.isfinite(x) & np.isfinite(y)) | (x == y)


def unmatched(v: np.ndarray, na: np.ndarray, nb: np.ndarray, rel: float, abs_tol: float) -> tuple[int, int]:
    """Rows of a and of b that a maximum matching leaves over: row i is the vector v[i] (of equal length), na[i] times in a and nb[i] in b.

    Of single numbers each takes the least that is close and free, in sorted order, which is a maximum since both ends of what is close move
    up with the number.  Of longer vectors, rows are matched along augmenting paths; a search that finds none closes all it has seen.
    """
    a, b = np.flatnonzero(na > 0), np.flatnonzero(nb > 0)
    if not v.shape[1]:
        met = min(int(na.sum()), int(nb.sum()))
        return int(na.sum()) - met, int(nb.sum()) - met
    a, b = a[np.argsort(v[a, 0], kind="stable")], b[np.argsort(v[b, 0], kind="stable")]
    free_a, free_b = na[a].astype(np.int64), nb[b].astype(np.int64)
    (_in_order if v.shape[1] == 1 else _by_paths)(v[a], v[b], free_a, free_b, rel, abs_tol)
    return int(free_a.sum()), int(free_b.sum())


def _in_order(x: np.ndarray, y: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, rel: float, abs_tol: float) -> None:
    j = 0
    for i in range(len(x)):
        while j < len(y) and free_a[i]:
            if not near(x[i], y[j], rel, abs_tol)[0]:
                if y[j, 0] > x[i, 0]:
                    break
                j += 1
                continue
            took = min(free_a[i], free_b[j])
            free_a[i] -= took
            free_b[j] -= took
            j += not free_b[j]


def _by_paths(x: np.ndarray, y: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, rel: float, abs_tol: float) -> None:
    reach = np.maximum(rel * np.abs(x[:, 0]) / (1 - rel), abs_tol) * (1 + 1e-9)
    low, high = np.searchsorted(y[:, 0], x[:, 0] - reach, "left"), np.searchsorted(y[:, 0], x[:, 0] + reach, "right")
    flow: list[dict[int, int]] = [{} for _ in y]  # of each row of y: which rows of x hold how many of it
    closed = np.zeros(len(y), dtype=bool)

    def close_to(i: int) -> np.ndarray:
        return low[i] + np.flatnonzero(near(x[i], y[low[i] : high[i]], rel, abs_tol).all(axis=1))

    for i in range(len(x)):
        for j in close_to(i)[:64]:  # most find their own at once
            if took := min(free_a[i], free_b[j]):
                flow[j][i] = flow[j].get(i, 0) + int(took)
                free_a[i] -= took
                free_b[j] -= took
    for i in range(len(x)):
        while free_a[i]:
            came, seen, open_, end = {i: -1}, {}, deque([i]), -1
            while open_ and end < 0:
                one = open_.popleft()
                for j in close_to(one).tolist():
                    if j in seen or closed[j]:
                        continue
                    seen[j] = one
                    if free_b[j]:
                        end = j
                        break
                    for other in flow[j]:
                        if other not in came:
                            came[other] = j
                            open_.append(other)
            if end < 0:
                closed[list(seen)] = True
                break
            path, j = [], end
            while j >= 0:
                path.append((seen[j], j))
                j = came[seen[j]]
            took = min([int(free_a[i]), int(free_b[end]), *(flow[j][one] for one, j in zip((p[0] for p in path[:-1]), (p[1] for p in path[1:]), strict=True))])
            for n, (one, j) in enumerate(path):
                flow[j][one] = flow[j].get(one, 0) + took
                if n + 1 < len(path):
                    old = path[n + 1][1]
                    flow[old][one] -= took
                    if not flow[old][one]:
                        del flow[old][one]
            free_a[i] -= took
            free_b[end] -= took


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key`` in such parts that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column("key"))
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut or (held and held[-1].column("key")[-1].as_py() != keys[0]):
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
            yield from whole
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def stretches(rows: DataFrame, key: str, nth: int, rel: float, abs_tol: float) -> DataFrame:
    """rows (key, v, ...) with ``stretch``: of the rows of a key, sorted by the nth number of v, one begins wherever the step from the number before
    is beyond the tolerance, so that no close pair lies in two.  Sorted in ranges; a table of one row a range joins them."""
    value = F.coalesce(F.get("v", F.lit(nth)), F.lit(0.0))
    laid = laid_out(rows.withColumn("__value", value), key, "__value")
    here = F.struct(F.col(key).alias("k"), F.col("__value").alias("x"))
    ends = laid.groupBy("__part").agg(F.max_by(here, "__at").alias("end"))
    ends = ends.select("__part", F.lag("end").over(Window.orderBy("__part")).alias("__end"))
    cut = laid.join(F.broadcast(ends), "__part", "left")
    cut = cut.withColumn("__prev", F.coalesce(F.lag(here).over(Window.partitionBy("__part").orderBy("__at")), F.col("__end")))
    goes_on = F.col("__prev")["k"].eqNullSafe(F.col(key)) & is_close(F.col("__prev")["x"], F.col("__value"), rel, abs_tol)
    cut = cut.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).drop("__prev", "__end", "__value")
    return with_sums(cut, stretch=F.col("__new")).withColumn("stretch", F.col("stretch") + F.col("__new")).drop("__new", "__part", "__at")


def as_vector(names_kinds) -> tuple[Column, Column]:
    """(which of the tolerant cells are null, all their numbers as one vector)."""
    empty = F.array().cast("array<double>")
    flat = [c for c, nested in names_kinds if not nested]
    nulls = F.array(*(F.col(c).isNull() for c in flat)) if flat else F.array(F.lit(False))
    parts = [F.col(c) if nested else F.when(F.col(c).isNull(), empty).otherwise(F.array(c)) for c, nested in names_kinds]
    return nulls, F.concat(*parts) if parts else empty
