"""Losses of groups over a grid of parameters: a group is one row with its values, and the grid is only unfolded in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import running_sum

#: Rows of a block of ``best_before``, if the window isn't longer.
BLOCK = 4096


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists that aren't empty, and where each list begins."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), (ends[:-1] - ends[0]).astype(np.int64)


def numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def over_grid(groups: DataFrame, keep: Sequence[str], f: Callable[[pa.RecordBatch], np.ndarray], grid: Sequence[float], key: str, value: str) -> DataFrame:
    """``(*keep, key, value)``: a row for each group and point of ``grid``; ``f`` turns a batch of groups into a matrix of values, nan for null."""
    n = len(grid)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = pa.array(np.ascontiguousarray(f(batch), dtype=np.float64).ravel(), from_pandas=True)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(offsets, flat)], [*keep, "_v"])

    kinds = dict(groups.dtypes)
    rows = groups.mapInArrow(walk, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "_v array<double>"]))
    points = F.array(*[F.lit(float(g)) for g in grid])
    return rows.select(*keep, F.posexplode("_v").alias("_at", value)).select(*keep, points[F.col("_at")].alias(key), value)


def best_before(
    rows: DataFrame, order: Sequence[str], group: str, window: int, f: Callable[[pa.RecordBatch], np.ndarray], grid: Sequence[float],
    best: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str, current: bool = False,
) -> DataFrame:
    """``(group, n, name)``: each row's number in ``order``, and the point of ``grid`` that is best over the ``window`` rows before it
    (or up to it, with ``current``), of which there may be fewer.

    Rows move with their values, not with their matrix. They are dealt into blocks of consecutive ones, a block also gets the
    ``window`` rows before it, and only there ``f`` unfolds the grid: a task holds a block. Within parts of ``window`` rows, running
    sums from either side, added, are a row's total, so no sums are subtracted. ``best`` picks from totals and numbers of rows.
    """
    size = window * max(1, BLOCK // window)
    numbered = running_sum(rows, order, F.lit(1).cast("long"), "n").withColumn("_b", F.floor((F.col("n") - 1) / size))
    tail = (F.col("n") - 1) % size >= size - window
    dealt = numbered.withColumn("_block", F.explode(F.when(tail, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array("_b"))))
    points = np.array([float(g) for g in grid])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("n").combine_chunks()
        own = table["_b"].to_numpy() == table["_block"].to_numpy()
        if not own.any():  # what follows the last block
            return pa.table({group: table[group].slice(0, 0), "n": table["n"].slice(0, 0), name: pa.array([], pa.float64())})
        values = np.nan_to_num(f(table.to_batches()[0]))
        total, count = np.zeros_like(values), np.zeros(len(values), np.int64)
        for lo in range(0, len(values), window):
            part = values[lo : lo + window]
            m, run = len(part), np.cumsum(part, axis=0)
            if current:
                total[lo : lo + m], count[lo : lo + m] = run, np.arange(1, m + 1)
            else:
                total[lo + 1 : lo + m], count[lo : lo + m] = run[:-1], np.arange(m)
            if lo:
                back = np.vstack([np.cumsum(values[lo - window : lo][::-1], axis=0)[::-1], np.zeros((1, values.shape[1]))])
                first = 1 if current else 0
                total[lo : lo + m] += back[first : first + m]
                count[lo : lo + m] += window - first - np.arange(m)
        at = points[best(total[own], count[own])]
        kept = table.filter(pa.array(own))
        return pa.table({group: kept[group], "n": kept["n"], name: pa.array(at)})

    kind = dict(rows.dtypes)[group]
    return dealt.groupBy("_block").applyInArrow(solve, f"`{group}` {kind}, n long, {name} double")
