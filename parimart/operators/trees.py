"""Walk-forward boosted trees: one model for each year, fitted on the years before it, all in the same passes.

Features are binned once and rows with the same bins become one cell, with its rows and winners before each year, as prefix
sums over years: what one year's model is fitted on is a column of the cells. A pass over the cells adds up the gradients of
all models by (model, node, feature, bin); the driver picks the splits from these sums, whose number the parameters bound.

Where the bins allow ``HELD`` cells at most, whatever the number of rows, each model is fitted on its cells by one task instead,
all models side by side in a single job; both ways take the same splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored

ROUNDS, DEPTH, BINS = 200, 2, 32
#: Share of a leaf's step that is taken, penalty of its square, and rows that a leaf has at least.
RATE, L2, LEAST = 0.1, 1.0, 20
#: Rounds after which the cells are stored again with what the trees so far say.
STORE = 25
#: Cells that the bins may make for a model to be fitted by one task: about 3 MB of them.
HELD = 1 << 16


class Trees(NamedTuple):
    """One round's trees, a row each model: feature and last bin to the left of every inner node, by level, and leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray


class WalkForward(NamedTuple):
    """``years[i]`` has a model fitted on all years before it; ``gains`` and ``splits`` are by (model, feature)."""

    features: list[str]
    edges: list[list[float]]
    years: list[int]
    middle: np.ndarray
    prior: np.ndarray
    rounds: list[Trees]
    gains: np.ndarray
    splits: np.ndarray


def _bin(c: str, edges: Sequence[float]) -> Column:
    """The number of edges below a value; one more than there can be if it is missing."""
    value = F.col(c).cast("double")
    missing = value.isNull() | F.isnan(value)
    return F.when(missing, len(edges) + 1).otherwise(F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda n, e: n + (value > e).cast("int")))


def _nodes(bins: np.ndarray, trees: Trees, model: int, levels: int) -> np.ndarray:
    """The node of each row after so many levels; a level's nodes follow those of the levels above."""
    node = np.zeros(len(bins), np.int64)
    for level in range(levels):
        at = (1 << level) - 1 + node
        node = 2 * node + (bins[np.arange(len(bins)), trees.feature[model, at]] > trees.cut[model, at])
    return node


def _margins(bins: np.ndarray, rounds: Sequence[Trees], model: int, depth: int) -> np.ndarray:
    out = np.zeros(len(bins))
    for trees in rounds:
        out += trees.leaf[model, _nodes(bins, trees, model, depth)]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _start(first: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prior log odds and median bins of models, from (model, feature, bin) sums of winners, rows and rows."""
    total = first[:, 0].sum(axis=1)  # every row is in some bin of the first feature
    prior = np.clip(total[:, 0] / np.maximum(total[:, 2], 1), 1e-6, 1 - 1e-6)
    seen = np.stack([np.where(np.arange(first.shape[2]) < e, first[:, j, :, 2], 0) for j, e in enumerate(missing)], axis=1).cumsum(axis=2)
    return np.log(prior / (1 - prior)), (2 * seen < seen[:, :, -1:]).argmin(axis=2)


def _pull(n: np.ndarray, p: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Gradient, curvature and rows of cells of ``n`` rows and ``p`` winners at log odds ``z``."""
    q = 1 / (1 + np.exp(-z))
    return np.stack([p - n * q, n * q * (1 - q), n], axis=1)


def _by_node(b: np.ndarray, node: np.ndarray, value: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """Sums of ``value`` by (node, feature, bin)."""
    out = np.zeros((nodes, b.shape[1], size, 3))
    for j in range(b.shape[1]):
        for k in range(3):
            out[:, j, :, k] = np.bincount(node * size + b[:, j], value[:, k], nodes * size).reshape(nodes, size)
    return out


def _blank(models: int, depth: int, size: int) -> Trees:
    inner = (1 << depth) - 1
    return Trees(np.zeros((models, inner), int), np.full((models, inner), size - 1), np.zeros((models, 1 << depth)))


def _grow(tree: Trees, i: int, level: int, found: np.ndarray, rate: float, l2: float, least: int, gains: np.ndarray, splits: np.ndarray) -> None:
    """Split model ``i``'s nodes of a level by their sums, and set the leaves below the last one."""
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    for node in range(1 << level):
        left = found[node].cumsum(axis=1)
        whole = left[:, -1:]
        right = whole - left
        gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), score(left) + score(right) - score(whole), 0.0)
        j, cut = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
        if gain[j, cut] > 1e-9:
            at = (1 << level) - 1 + node
            tree.feature[i, at], tree.cut[i, at] = j, cut
            gains[i, j] += gain[j, cut]
            splits[i, j] += 1
            sides = left[j, cut], right[j, cut]
        else:
            sides = whole[0, 0], whole[0, 0]
        if 2 << level == tree.leaf.shape[1]:
            for k, s in enumerate(sides):
                tree.leaf[i, 2 * node + k] = rate * s[0] / (s[1] + l2)


def fit_walkforward(
    df: DataFrame, year: str, features: Sequence[str], label: str, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
    l2: float = L2, least: int = LEAST, store: int = STORE, held: int = HELD,
) -> WalkForward:
    """Boosted trees (logistic loss, Newton leaves) for every year but the first.

    Bins end at the features' quantiles, for which labels are not used. A missing value counts as the median bin of a model's
    own rows, the first bin if it has none. Of equal gains the first feature's lowest cut is taken, a node without a gain
    isn't split. Rows without a year or a label teach nothing. ``held`` is explained above.
    """
    d, known = len(features), df.where(F.col(year).isNotNull() & F.col(label).isNotNull())
    years = sorted(r[0] for r in known.select(year).distinct().collect())  # as many as the calendar has
    cuts = [k / bins for k in range(1, bins)]
    quantiles = known.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(list(features), cuts, 0.001) if years else []
    edges = [sorted(set(q)) for q in quantiles] or [[] for _ in features]
    after, width = years[1:], max(map(len, edges), default=0) + 1
    m = len(after)
    if not m:
        return WalkForward(list(features), edges, [], np.zeros((0, d), int), np.zeros(0), [], np.zeros((0, d)), np.zeros((0, d), int))
    before = lambda of: F.array(*[F.coalesce(F.sum(F.when(F.col(year) < y, of)), F.lit(0.0)) for y in after])
    cells = known.withColumn("_b", F.array(*[_bin(f, e) for f, e in zip(features, edges, strict=True)])).groupBy("_b").agg(
        before(F.lit(1.0)).alias("_n"), before((F.col(label) == 1).cast("double")).alias("_p")
    )
    missing = np.array([len(e) + 1 for e in edges])
    if np.prod(missing + 1.0) <= held:
        return WalkForward(list(features), edges, after, *_fit_apart(cells, m, missing, width + 1, rounds, depth, rate, l2, least))
    cells = stored(cells.withColumn("_z", F.array(*[F.lit(0.0)] * m)), "cells")

    def filled(raw: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return np.where(raw == missing, middle, raw)

    def sums(run) -> np.ndarray:
        """What tasks count by slot, added up by Spark."""
        found = cells.mapInArrow(run, "slot int, g double, h double, n double").groupBy("slot").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        out = np.zeros((m << depth - 1 if depth else m) * d * (width + 1) * 3).reshape(-1, 3)
        out[found.column("slot").to_numpy()] = np.stack([found.column(c).to_numpy() for c in "ghn"], axis=1)
        return out.reshape(m, -1, d, width + 1, 3)

    def counted(histogram: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = histogram.reshape(-1, 3)
        used = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(flat[used, k]) for k in range(3))], ["slot", *"ghn"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((m, 1 << max(0, depth - 1), d, width + 1, 3))
        for batch in batches:
            raw, n, p = _matrix(batch.column(0), d), _matrix(batch.column(1), m), _matrix(batch.column(2), m)
            for i in range(m):
                for j in range(d):
                    np.add.at(out[i, 0, j], raw[:, j], np.stack([p[:, i], n[:, i], n[:, i]], axis=1))
        yield from counted(out)

    prior, middle = _start(sums(count)[:, 0], missing)

    def level_sums(level: int, done: list[Trees], tree: Trees) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((m, 1 << max(0, depth - 1), d, width + 1, 3))
            for batch in batches:
                raw, n, p, z = (_matrix(batch.column(c), w) for c, w in enumerate((d, m, m, m)))
                for i in range(m):
                    rows = np.flatnonzero(n[:, i])
                    b = filled(raw[rows], middle[i])
                    value = _pull(n[rows, i], p[rows, i], prior[i] + z[rows, i] + _margins(b, done, i, depth))
                    out[i, : 1 << level] += _by_node(b, _nodes(b, tree, i, level), value, 1 << level, width + 1)
            yield from counted(out)

        return sums(run)

    gains, splits, made = np.zeros((m, d)), np.zeros((m, d), int), []
    for r in range(rounds):
        if r and r % store == 0:
            cells = stored(_advanced(cells, made[r - store :], middle, missing, depth), "cells")
        done = made[r // store * store :]
        tree = _blank(m, depth, width + 1)
        for level in range(depth):
            found = level_sums(level, done, tree)
            for i in range(m):
                _grow(tree, i, level, found[i], rate, l2, least, gains, splits)
        made.append(tree)
    return WalkForward(list(features), edges, after, middle, prior, made, gains, splits)


def _fit_apart(cells: DataFrame, m: int, missing: np.ndarray, size: int, rounds: int, depth: int, rate: float, l2: float, least: int) -> tuple:
    """What follows ``years`` in a ``WalkForward``, each model fitted by a task on its cells, whose number the bins bound."""
    d, inner = len(missing), (1 << depth) - 1
    own = F.posexplode(F.transform(F.arrays_zip("_n", "_p"), lambda c: c))
    rows = cells.select("_b", own.alias("_i", "_c")).select("_i", "_b", F.col("_c._n").alias("n"), F.col("_c._p").alias("p")).where("n > 0")
    kinds = {"middle": "array<int>", "prior": "double", "feature": "array<int>", "cut": "array<int>", "leaf": "array<double>", "gains": "array<double>", "splits": "array<int>"}

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        raw = _matrix(table.column("_b").combine_chunks(), d)
        n, p = (table.column(c).to_numpy() for c in "np")
        order = np.lexsort(raw.T)  # sums don't depend on how rows came
        raw, n, p = raw[order], n[order], p[order]
        prior, middle = _start(_by_node(raw, np.zeros(len(n), int), np.stack([p, n, n], axis=1), 1, size), missing)
        b = np.where(raw == missing, middle[0], raw)
        z, made, gains, splits = np.full(len(n), prior[0]), [], np.zeros((1, d)), np.zeros((1, d), int)
        for _ in range(rounds):
            tree, value = _blank(1, depth, size), _pull(n, p, z)
            for level in range(depth):
                _grow(tree, 0, level, _by_node(b, _nodes(b, tree, 0, level), value, 1 << level, size), rate, l2, least, gains, splits)
            z += _margins(b, [tree], 0, depth)
            made.append(tree)
        parts = [np.concatenate([getattr(t, f)[0] for t in made]) if made else np.zeros(0) for f in Trees._fields]
        out = [middle[0], prior[0], *parts, gains[0], splits[0]]
        whole = {"middle", "feature", "cut", "splits"}
        arrays = [pa.array([v.astype(np.int32 if k in whole else float) if k != "prior" else v]) for k, v in zip(kinds, out, strict=True)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *arrays], ["_i", *kinds])

    found = rows.groupBy("_i").applyInArrow(fit, ", ".join(f"{k} {v}" for k, v in {"_i": "int", **kinds}.items())).collect()  # a row a year
    found.sort(key=lambda r: r["_i"])
    take = {k: np.array([r[k] for r in found]) for k in kinds}
    made = [
        Trees(take["feature"][:, r * inner : (r + 1) * inner], take["cut"][:, r * inner : (r + 1) * inner], take["leaf"][:, r << depth : (r + 1) << depth])
        for r in range(rounds)
    ]
    return take["middle"], take["prior"], made, take["gains"], take["splits"]


def _advanced(cells: DataFrame, rounds: list[Trees], middle: np.ndarray, missing: np.ndarray, depth: int) -> DataFrame:
    m, d = middle.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, z = _matrix(batch.column(0), d), _matrix(batch.column(3), m).copy()
            for i in range(m):
                z[:, i] += _margins(np.where(raw == missing, middle[i], raw), rounds, i, depth)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(z), pa.list_(pa.float64()))], batch.schema.names)

    return cells.mapInArrow(run, cells.schema)


def score_walkforward(df: DataFrame, year: str, model: WalkForward) -> DataFrame:
    """The rows of years that have a model, with that model's ``score``, a probability; the model is as large as its parameters say."""
    missing, depth = np.array([len(e) + 1 for e in model.edges]), max(0, (model.rounds[0].leaf.shape[1]).bit_length() - 1) if model.rounds else 0
    rows = df.where(F.col(year).isin(model.years)).withColumns({"_b": F.array(*[_bin(f, e) for f, e in zip(model.features, model.edges, strict=True)])})
    place = F.array_position(F.array(*[F.lit(y) for y in model.years] or [F.lit(0)]), F.col(year)) - 1
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = held.value
        for batch in batches:
            raw, of = _matrix(batch.column(batch.num_columns - 2), len(missing)), batch.column(batch.num_columns - 1).to_numpy()
            score = np.zeros(len(of))
            for i in np.unique(of):
                rows = np.flatnonzero(of == i)
                z = fit.prior[i] + _margins(np.where(raw[rows] == missing, fit.middle[i], raw[rows]), fit.rounds, i, depth)
                score[rows] = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(score)], [*batch.schema.names[:-2], "score"])

    return rows.withColumn("_m", place.cast("int")).mapInArrow(run, StructType(list(df.schema.fields)).add("score", "double"))


def importances(spark, model: WalkForward) -> DataFrame:
    """``(year, feature, gain, splits)`` of every model."""
    rows = [
        (int(y), f, float(model.gains[i, j]), int(model.splits[i, j])) for i, y in enumerate(model.years) for j, f in enumerate(model.features)
    ]
    return spark.createDataFrame(rows, "year int, feature string, gain double, splits int")
