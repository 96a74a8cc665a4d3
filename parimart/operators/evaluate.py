"""Evaluation of probabilities and selections: calibration, returns, bootstraps, blends and classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import trees
from .grids import lists, over_grid
from .relational import remove_top, running_sum, top_k

# Weights of a blend, and resamples of a bootstrap.
BLENDS, DRAWS = tuple(round(0.025 * k, 3) for k in range(81)), 500


def backtest(df: DataFrame, race: str, item: str, score: Column, position: str) -> DataFrame:
    """One row: races, top-pick wins and top-3 finishes, mean reciprocal rank of the winner."""
    w = Window.partitionBy(race).orderBy(F.desc("_s"), item)
    ranked = df.withColumn("_s", score).withColumn("_r", F.row_number().over(w))
    by = ranked.groupBy(race).agg(
        F.max(F.when(F.col("_r") == 1, F.col(position))).alias("top"), F.max(F.when(F.col(position) == 1, 1.0 / F.col("_r"))).alias("rr")
    )
    n = F.count(F.lit(1))
    return by.agg(n.alias("races"), F.count_if(F.col("top") == 1).alias("wins"), F.count_if(F.col("top") <= 3).alias("top3"), (F.sum(F.coalesce("rr", F.lit(0.0))) / n).alias("mrr"))


def kelly_stake(p: Column, odds: Column, unit: float, fraction: float) -> Column:
    """Fractional Kelly part of ``unit``, 0 without an edge."""
    edge = p * odds - 1.0
    return F.when((odds > 1) & (p > 0) & (edge > 0), unit * F.least(F.lit(1.0), F.greatest(F.lit(0.0), edge / (odds - 1.0) * fraction))).otherwise(0.0)


def roi_report(bets: DataFrame, stake: str, back: str, capacity: float = 0.0) -> DataFrame:
    total, ret = F.sum(stake), F.sum(back)
    n = F.count(F.lit(1))
    return bets.agg(
        n.alias("bets"), total.alias("stake"), ret.alias("returned"), F.round(ret / total - 1, 4).alias("roi"),
        F.round(ret * (1 - capacity) / total - 1, 4).alias("capacity_roi"), F.round(F.count_if(F.col(back) > 0) / n, 4).alias("hit_rate"),
    )


def trimmed_roi(bets: DataFrame, stake: str, back: str, tops: Sequence[int], ties: Sequence[str]) -> DataFrame:
    """ROI without the largest returns, for each number left out; the top rows alone are ranked in one task."""
    top = bets.orderBy(F.desc(back), *ties).limit(max(tops)).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc(back), *ties)))
    all_ = bets.agg(F.sum(stake).alias("s"), F.sum(back).alias("r"))
    out = top.select("_rn", stake, back, F.explode(F.array(*[F.lit(n) for n in tops])).alias("removed")).where("_rn <= removed")
    gone = out.groupBy("removed").agg(F.sum(stake).alias("gs"), F.sum(back).alias("gr"))
    return gone.join(F.broadcast(all_)).select("removed", F.round((F.col("r") - F.col("gr")) / (F.col("s") - F.col("gs")) - 1, 4).alias("roi"))


def calibration_quality(df: DataFrame, won: Column, models: Sequence[str]) -> DataFrame:
    """Winner log-loss and Brier score of each model in one pass."""
    y = won.cast("double")
    out = [F.count_if(won).alias("winners")]
    for m in models:
        out.append((F.sum(F.when(won, -F.ln(F.greatest(F.col(m), F.lit(1e-12))))) / F.count_if(won)).alias(f"{m}_log_loss"))
        out.append(F.avg((F.col(m) - y) * (F.col(m) - y)).alias(f"{m}_brier"))
    return df.agg(*out)


def binned(p: Column, edges: Sequence[float], closed: str = "right") -> Column:
    """Index of the bin that holds ``p``: (lo, hi] or [lo, hi) with the last closed; null outside."""
    out = None
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        last = k == len(edges) - 2
        inside = (p > lo) & (p <= hi) if closed == "right" else (p >= lo) & ((p <= hi) if last else (p < hi))
        out = F.when(inside, k) if out is None else out.when(inside, k)
    return out


def calibration_bins(df: DataFrame, by: str, models: Sequence[str], won: Column, edges: Sequence[float], closed: str = "right", thin: int = 0, group: Sequence[str] = ()) -> DataFrame:
    """Per bin (and ``group``): rows, mean of each model, observed rate, Brier scores, and whether it is thin."""
    y = won.cast("double")
    n = F.count(F.lit(1))
    aggs = [n.alias("n"), F.avg(y).alias("observed"), (n < thin).alias("thin")]
    for m in models:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.avg((F.col(m) - y) * (F.col(m) - y)).alias(f"brier_{m}")]
    return df.withColumn("bin", binned(F.col(by), edges, closed)).where("bin is not null").groupBy(*group, "bin").agg(*aggs)


def era_split(df: DataFrame, era: Column, order: Sequence[str], share: float = 0.7) -> DataFrame:
    """``split``: the first ``share`` of each era's rows train (one at least), the others test."""
    e = running_sum(df.withColumn("era", era), ["era", *order], F.lit(1).cast("long"), "_n")
    # One row per era.
    size = e.groupBy("era").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_c")).withColumnRenamed("era", "_e")
    cut = F.greatest(F.lit(1), F.floor(F.col("_c") * share))
    out = e.join(size, e["era"].eqNullSafe(size["_e"])).withColumn("split", F.when(F.col("_n") - F.col("_first") < cut, "train").otherwise("test"))
    return out.drop("_n", "_e", "_first", "_c")


def bootstrap_draws(clusters: DataFrame, cluster: str, draws: int, seed: int = 0) -> DataFrame:
    """``(cluster, draw, times)``: how often each cluster comes up in each of ``draws`` resamples, of as many as there are.

    The clusters are numbered in their order; a resample has one place for each, and the hash of seed, draw and place picks its
    cluster: an exact multinomial that needs no sequence, and reruns and other engines agree. Places are counted by (draw,
    cluster) in the tasks before they move. Null is no cluster.
    """
    own = clusters.select(cluster).where(F.col(cluster).isNotNull()).distinct()
    numbered = stored(running_sum(own, [cluster], F.lit(1).cast("long"), "_place"), "clusters")
    n = max(1, numbered.count())
    grid = numbered.select("_place", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    name = F.concat_ws("-", F.lit(str(seed)), F.col("draw").cast("string"), F.col("_place").cast("string"))
    pick = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long") % n + 1
    times = grid.groupBy("draw", pick.alias("_pick")).agg(F.count(F.lit(1)).alias("times"))
    return times.join(numbered, F.col("_pick") == F.col("_place")).select(cluster, "draw", "times")


def cluster_bootstrap(df: DataFrame, cluster: str, numerator: str, denominator: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Ratio of sums with its 2.5 and 97.5 percentiles over resampled clusters; rows are summed per cluster first."""
    per = df.groupBy(cluster).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    by = bootstrap_draws(per, cluster, draws, seed).join(per, cluster).groupBy("draw").agg(
        (F.sum(F.col("times") * F.col("a")) / F.sum(F.col("times") * F.col("b"))).alias("m")
    )
    ci = by.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return per.agg((F.sum("a") / F.sum("b")).alias("point")).join(F.broadcast(ci))


def blend_losses(df: DataFrame, race: str, logits: Sequence[str], won: Column, grid: Sequence[Sequence[float]], group: Sequence[str] = ()) -> DataFrame:
    """Summed race log-loss of softmax blends of ``logits`` for each row of weights in a grid.

    A race is one row with its logits until the grid is unfolded, after the shuffle; sums are then taken in the tasks.
    """
    n, weights = len(logits), [[float(x) for x in g] for g in grid]
    held = [F.collect_list(F.col(c).cast("double")).alias(f"_z{k}") for k, c in enumerate(logits)]
    known = df.withColumn("_w", F.coalesce(won, F.lit(False)))
    for c in logits:
        known = known.where(F.col(c).isNotNull())
    races = known.groupBy(*group, race).agg(*held, F.collect_list("_w").alias("_won")).where(F.exists("_won", lambda w: w))

    def losses(batch: pa.RecordBatch) -> np.ndarray:
        z, begin = zip(*[lists(batch.column(f"_z{k}")) for k in range(n)])
        won, begin = lists(batch.column("_won"))[0].astype(bool), begin[0]
        size = np.diff(np.append(begin, len(won)))
        out = np.empty((batch.num_rows, len(weights)))
        for j, g in enumerate(weights):
            x = sum((w * v for w, v in zip(g, z)), np.zeros(len(won)))
            most = np.maximum.reduceat(x, begin)
            total = np.add.reduceat(np.exp(x - np.repeat(most, size)), begin)
            out[:, j] = most + np.log(total) - np.maximum.reduceat(np.where(won, x, -np.inf), begin)
        return out

    each = over_grid(races, list(group), losses, range(len(weights)), "_g", "_loss")
    names = [F.array(*[F.lit(g[k]) for g in weights])[F.col("_g").cast("int")].alias(f"w{k}") for k in range(n)]
    return each.groupBy(*group, "_g").agg(F.sum("_loss").alias("nll"), F.count(F.lit(1)).alias("races")).select(*group, *names, "nll", "races")


def best_blend(losses: DataFrame, weights: Sequence[str]) -> DataFrame:
    return losses.agg(F.min_by(F.struct(*weights), F.struct(F.round("nll", 8), *weights)).alias("w"), F.min("nll").alias("nll")).select("w.*", "nll")


def bootstrap_blend(losses: DataFrame, cluster: str, weights: Sequence[float], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Mean and 2.5 and 97.5 percentiles of the best weight over resampled clusters, from ``losses(cluster, w0, nll)``.

    A cluster is one row with its losses for all of the short grid; of equal sums (8 places) the smallest weight is best.
    """
    at = [f"n{k}" for k in range(len(weights))]
    per = losses.groupBy(cluster).agg(*[F.sum(F.when(F.col("w0") == float(w), F.col("nll"))).alias(n) for w, n in zip(weights, at, strict=True)])
    drawn = bootstrap_draws(per, cluster, draws, seed).join(per, cluster).groupBy("draw").agg(*[F.sum(F.col("times") * F.col(n)).alias(n) for n in at])
    best = F.array_min(F.array(*[F.struct(F.round(n, 8).alias("nll"), F.lit(float(w)).alias("w0")) for w, n in zip(weights, at, strict=True)]))["w0"]
    found = drawn.select(best.alias("w0"))
    return found.agg(F.avg("w0").alias("mean_weight"), F.percentile("w0", F.lit(0.025)).alias("lo"), F.percentile("w0", F.lit(0.975)).alias("hi"))


def quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row: the exact ``q`` quantile of a column, between two values linearly, as ``percentile`` gives it (null without values).

    A sketch bounds it from both sides; what lies below is counted, and only the distinct values between (about 0.2 % of the
    rows) are ordered in one task.
    """
    df = df.where(F.col(value).isNotNull())
    n = df.count()
    near = [max(0.0, q - 0.001 - 2 / max(n, 1)), min(1.0, q + 0.001 + 2 / max(n, 1))]
    ends = df.agg(F.percentile_approx(value, near, 10000).alias("e")).first()["e"] or [0.0, 0.0]
    below = df.where(F.col(value) < ends[0]).count()
    at = q * (n - 1)
    values = df.where(F.col(value).between(ends[0], ends[1])).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + below
    pick = lambda k: F.min(F.when(F.col("_upto") > int(k), F.col("_v")))
    low, high = np.floor(at), np.ceil(at)
    between = pick(low) if low == high else float(high - at) * pick(low) + float(at - low) * pick(high)
    return values.withColumn("_upto", upto).agg(between.alias(name))


def edge_roi(df: DataFrame, race: str, item: str, p: str, odds: str, won: Column, capacities: Sequence[float], drop: Sequence[int]) -> DataFrame:
    """Bets where p * odds reaches 1 / (1 - capacity), without each race's ``drop`` largest edges; unit stakes."""
    rows = df.withColumn("_w", won).withColumn("capacity", F.explode(F.array(*[F.lit(float(c)) for c in capacities])))
    rows = rows.withColumn("edge", F.col(p) * F.col(odds)).where(F.col("edge") >= 1.0 / (1.0 - F.col("capacity")))
    rank = F.row_number().over(Window.partitionBy(race, "capacity").orderBy(F.desc("edge"), item))
    rows = rows.withColumn("_rn", rank).withColumn("removed", F.explode(F.array(*[F.lit(d) for d in drop]))).where("_rn > removed")
    back = F.sum(F.when(F.col("_w"), F.col(odds) * (1.0 - F.col("capacity"))).otherwise(0.0))
    return rows.groupBy("capacity", "removed").agg(F.count(F.lit(1)).alias("bets"), back.alias("returned"), (back / F.count(F.lit(1)) - 1).alias("roi"))


def fit_logit_probs(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, group: Sequence[str]) -> DataFrame:
    """Balanced logistic regression; ``model_prob`` clipped and scaled to sum to one in each group."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rate = train.agg(F.avg(label).alias("r")).first()["r"] or 0.5
    weighed = train.withColumn("_wt", F.when(F.col(label) == 1, 0.5 / max(rate, 1e-9)).otherwise(0.5 / max(1 - rate, 1e-9)))
    pack = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_wt", maxIter=50).fit(pack.transform(weighed))
    out = model.transform(pack.transform(test)).withColumn("_p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), vector_to_array("probability")[1])))
    total = F.sum("_p").over(Window.partitionBy(*group))
    return out.withColumn("model_prob", F.col("_p") / total).drop("_x", "_p", "rawPrediction", "probability", "prediction")


def fit_classifier_walkforward(df: DataFrame, year: str, features: Sequence[str], label: str, maxIter: int = trees.ROUNDS, **params) -> DataFrame:
    """Boosted trees (``maxIter`` of them) for each year on the years before it; ``score`` and the splits per feature of its model (``splits_...``)
    for every row that has one."""
    model = trees.fit_walkforward(df, year, features, label, rounds=maxIter, **params)
    scored = trees.score_walkforward(df, year, model)
    used = trees.importances(df.sparkSession, model).groupBy(F.col("year").alias("_year")).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("splits"))).alias(f"splits_{f}") for f in features]
    )
    return scored.join(F.broadcast(used), F.col(year) == F.col("_year"), "left").drop("_year")  # a row for each year


def _logit_sums(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Loss, gradient and curvature of a softmax within races, summed over what a task reads."""
    d = len(w)
    out = np.zeros(1 + d + d * d)
    for batch in batches:
        lists = batch.column(0)
        if not len(lists):
            continue
        rows = lists.flatten()
        begin = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        won, *cols = (np.asarray(c) for c in rows.flatten())
        x = np.stack(cols, axis=1)
        of = np.repeat(np.arange(len(begin)), np.diff([*begin, len(x)]))
        z = x @ w
        top = np.maximum.reduceat(z, begin)
        e = np.exp(z - top[of])
        total, wins = np.add.reduceat(e, begin), np.add.reduceat(won, begin)
        p = e / total[of]
        mean = np.add.reduceat(p[:, None] * x, begin, axis=0)
        out[0] += wins @ (np.log(total) + top) - won @ z
        out[1 : d + 1] += wins @ mean - won @ x
        out[d + 1 :] += ((x * (p * wins[of])[:, None]).T @ x - (mean * wins[:, None]).T @ mean).ravel()
    yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["v"])


def _logit_losses(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Loss of each column of weights, summed over what a task reads."""
    out = np.zeros(w.shape[1])
    for batch in batches:
        lists = batch.column(0)
        if not len(lists):
            continue
        rows = lists.flatten()
        begin = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        won, *cols = (np.asarray(c) for c in rows.flatten())
        z = np.stack(cols, axis=1) @ w
        top = np.maximum.reduceat(z, begin, axis=0)
        of = np.repeat(np.arange(len(begin)), np.diff([*begin, len(z)]))
        total = np.add.reduceat(np.exp(z - top[of]), begin, axis=0)
        out += np.add.reduceat(won, begin) @ (np.log(total) + top) - won @ z
    yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["v"])


def fit_conditional_logit(df: DataFrame, race: str, features: Sequence[str], won: Column, l2: float = 0.01, bound: float = 5.0, steps: int = 50, tolerance: float = 1e-6) -> list[float]:
    """Weights, within ``bound``, of a softmax within races: least sum of -log p over winners, plus ``l2`` times their squares.

    Missing values become the median of their column, or 0. A race counts once per winner, without one not at all. Races
    are gathered and stored once, a row each; every Newton step reads them without a shuffle, and 1 + d + d * d sums come back.
    It ends when the gradient of the weights that are free to move is below ``tolerance`` a race, or no step gets lower.
    """
    d = len(features)
    value = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features]
    middle = df.select(*[v.alias(f"m{j}") for j, v in enumerate(value)]).agg(*[F.median(f"m{j}") for j in range(d)]).first()
    x = [F.coalesce(v, F.lit(middle[j] or 0.0)).alias(f"x{j}") for j, v in enumerate(value)]
    runner = F.struct(F.coalesce(won.cast("double"), F.lit(0.0)).alias("won"), *x)
    gathered = stored(df.groupBy(race).agg(F.collect_list(runner).alias("r")).select("r"), "races")
    races = max(1, gathered.count())

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = gathered.mapInArrow(lambda it: _logit_sums(it, w), "v array<double>")
        row = sums.agg(*[F.sum(F.col("v")[j]) for j in range(1 + d + d * d)]).first()
        v = np.array([s or 0.0 for s in row])
        return v[0] + l2 * float(w @ w), v[1 : d + 1] + 2 * l2 * w, v[d + 1 :].reshape(d, d) + 2 * l2 * np.eye(d)

    def losses(ws: list[np.ndarray]) -> list[float]:
        sums = gathered.mapInArrow(lambda it: _logit_losses(it, np.stack(ws, axis=1)), "v array<double>")
        row = sums.agg(*[F.sum(F.col("v")[j]) for j in range(len(ws))]).first()
        return [(s or 0.0) + l2 * float(x @ x) for s, x in zip(row, ws, strict=True)]

    w = np.zeros(d)
    loss, slope, curve = at(w)
    for _ in range(steps):
        free = ~((w <= -bound) & (slope > 0) | (w >= bound) & (slope < 0))
        if not free.any() or np.abs(slope[free]).max() <= tolerance * races:
            break
        newton, steepest = np.zeros(d), np.where(free, slope / np.diag(curve), 0.0)
        newton[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        tries = [np.clip(w - 0.5**k * way, -bound, bound) for way in (newton, steepest) for k in range(12)]
        there = tries[0]
        found = at(there)
        if not found[0] < loss:  # one pass over all shorter steps
            lower = [k for k, x in enumerate(losses(tries)) if x < loss]
            if not lower:
                break
            there = tries[lower[0]]
            found = at(there)
            if not found[0] < loss:
                break
        w, (loss, slope, curve) = there, found
    return w.tolist()
