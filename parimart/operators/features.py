"""Point-in-time feature tables and their guards."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import stored
from .grids import best_before, lists, numbers, over_grid
from .histories import Question, ask_by_entity, by_length, last_known
from .relational import asof_join, growing_median, prior_history, running_sum

# Annotation labels that may become features.
PROXY_LABELS = ("paddock_agitation", "gate_behavior", "sweating", "poor_start_history", "equipment_change", "layoff_context", "travel_stress_indicator", "stable_comment", "article_sentiment")

# Exponents of the walk-forward calibration.
BETAS = tuple(round(0.25 + 0.05 * k, 2) for k in range(56))


class LeakageError(ValueError):
    """A row uses a source that became known after its decision time."""


def assert_point_in_time(df: DataFrame, source: str, as_of: str, drop: bool = False) -> DataFrame:
    """Raise if any row's latest source is after its decision time; with ``drop`` keep the others instead."""
    late = F.col(source) > F.col(as_of)
    if drop:
        return df.where(~F.coalesce(late, F.lit(False)))
    n = df.where(late).count()
    if n:
        raise LeakageError(f"{n} rows have {source} after {as_of}")
    return df


def assert_market_blind(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    found = sorted({c.lower() for c in df.columns} & {c.lower() for c in forbidden})
    if found:
        raise ValueError(f"market columns in a market-blind table: {found}")
    return df


def career_features(starts: DataFrame, entity: str, race: str, date: str, available: str, position: str, as_of: Column) -> DataFrame:
    """Career starts, wins, top-3 and rates known by ``as_of``, the current race left out."""
    target = starts.withColumn("as_of_time", as_of)
    sums = {"career_starts": F.lit(1), "career_wins": (F.col(position) == 1).cast("int"), "career_top3": (F.col(position) <= 3).cast("int")}
    out = prior_history(target, starts, entity, date, available, "as_of_time", sums)
    n = F.col("career_starts")
    return out.withColumn("win_rate", F.try_divide(F.col("career_wins"), n)).withColumn("top3_rate", F.try_divide(F.col("career_top3"), n))


def open_last_odds(targets: DataFrame, odds: DataFrame, key: Sequence[str], as_of: str, time: str, price: str) -> DataFrame:
    """First and latest odds by ``as_of`` and the drift between them in percent."""
    first = odds.groupBy(*key).agg(F.min_by(price, time).alias("open_odds"), F.min(time).alias("_open_at"))
    out = asof_join(targets, odds, key, as_of, time, [price]).withColumnRenamed(price, "last_odds").join(first, list(key), "left")
    seen = F.col("_open_at") <= F.col(as_of)
    out = out.withColumn("open_odds", F.when(seen, F.col("open_odds"))).drop("_open_at")
    return out.withColumn("odds_drift_pct", F.try_divide(F.col("last_odds") - F.col("open_odds"), F.col("open_odds")) * 100)


def trailing_rates(target: DataFrame, history: DataFrame, keys: Sequence[str], date: str, available: str, as_of: str, position: str, days: int, prefix: str) -> DataFrame:
    """Starts, win and top-3 rate of an entity (or pair, or entity and venue) over the last ``days``."""
    sums = {f"{prefix}_starts": F.lit(1), f"{prefix}_wins": (F.col(position) == 1).cast("int"), f"{prefix}_top3": (F.col(position) <= 3).cast("int")}
    out = prior_history(target, history, keys[0], date, available, as_of, sums, days=days, group=list(keys[1:]))
    n = F.col(f"{prefix}_starts")
    return out.withColumn(f"{prefix}_win_rate", F.try_divide(F.col(f"{prefix}_wins"), n)).withColumn(f"{prefix}_top3_rate", F.try_divide(F.col(f"{prefix}_top3"), n))


def recent_form(
    target: DataFrame, history: DataFrame, entity: str, date: str, available: str, as_of: str, position: str, time: str,
    values: Sequence[str] = (), ties: Sequence[str] = (), guard: Column | None = None,
) -> DataFrame:
    """Form over an entity's runs before the target's date and known by ``as_of``: the last one's place, time and other
    ``values``, days since it, mean place and time of the last five, wins and starts in the last ten.

    Runs are ordered by date and ``ties``, newest first. Rows and history meet once, by entity, and tasks find the last ten runs
    (``last_known``); of entities with more history than a task may hold, each distinct (entity, date, as_of) is joined to its runs.
    Without runs the counts are 0 and the others null. ``guard`` keeps placeholder entities out of the history.
    """
    if guard is not None:
        history = history.where(guard)
    held = list(dict.fromkeys([position, time, *values]))
    runs = history.select(
        F.col(entity).alias("_k0"), F.col(date).alias("_d"), F.col(available).alias("_t"), *[F.col(c).alias(f"_v_{c}") for c in held], *[F.col(c).alias(f"_t_{c}") for c in ties]
    ).dropna(subset=["_k0", "_d", "_t"])
    fields, later = ["_d", *[f"_v_{c}" for c in held]], [f"_t_{c}" for c in ties]
    short, own, long, long_runs = by_length(target, runs, ["_k0"], [entity])
    asked = {"_k0": entity, "_d": date, "_t": as_of}
    kind = ArrayType(StructType([StructField(c, runs.schema[c].dataType) for c in fields]))
    out = ask_by_entity(short, asked, own, ["_k0"], {}, last_known(fields, later, 10), StructType([StructField("_last", kind)]))
    if long is not None:
        out = out.unionByName(_last_by_join(long, long_runs, entity, date, as_of, fields, later))
    return out.select(*target.columns, *form_columns(history, date, position, time, values))


def _last_by_join(target: DataFrame, runs: DataFrame, entity: str, date: str, as_of: str, fields: Sequence[str], later: Sequence[str], most: int = 10) -> DataFrame:
    """``last_known`` without a bound on an entity's runs: each distinct (entity, date, as_of) is joined to them."""
    keys = list(dict.fromkeys([entity, date, as_of]))
    pairs = target.select(*keys).distinct().join(runs, (F.col(entity) == F.col("_k0")) & (F.col("_d") < F.col(date)) & (F.col("_t") <= F.col(as_of)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_d"), *[F.desc(c) for c in later])
    last = pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    listed = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias("_last"))
    listed = listed.withColumn("_last", F.transform("_last", lambda x: F.struct(*[x[c].alias(c) for c in fields])))
    return target.join(listed, keys, "left").select(*target.columns, "_last")


def form_question(rows: DataFrame, entity: str, when: tuple[str, str, str], held: Sequence[str], ties: Sequence[str], where: str | None = None) -> Question:
    """The last ten runs for ``ask_together``, as the list that ``form_columns`` reads."""
    date, available, as_of = when
    fields, later = {"_d": date, **{f"_v_{c}": c for c in held}}, {f"_t_{c}": c for c in ties}
    kind = ArrayType(StructType([StructField(n, rows.schema[c].dataType) for n, c in fields.items()]))

    def apart(target: DataFrame, facts: DataFrame) -> DataFrame:
        of = {"_k0": entity, "_t": available, **fields, **later}
        return _last_by_join(target, facts.select(*[F.col(c).alias(n) for n, c in of.items()]), entity, date, as_of, list(fields), list(later))

    return Question(last_known(list(fields), list(later), 10), {n: c for n, c in {**fields, **later}.items() if n != "_d"}, StructType([StructField("_last", kind)]), apart, where=where)


def form_columns(history: DataFrame, date: str, position: str, time: str, values: Sequence[str]) -> list[Column]:
    """The columns of ``recent_form`` from the list ``_last`` of runs, newest first."""

    def newest(c: str) -> Column:
        return F.get("_last", F.lit(0))[c]

    means = history.agg(*[F.avg(c).alias(c) for c in (position, time)]).schema

    def of_five(c: str) -> Column:
        there = F.filter(F.slice(F.col("_last")[f"_v_{c}"], 1, 5), lambda x: x.isNotNull()).cast(ArrayType(means[c].dataType))
        total = F.aggregate(there, F.lit(0).cast(means[c].dataType), lambda s, x: (s + x).cast(means[c].dataType))
        return F.try_divide(total, F.size(there)).cast(means[c].dataType)

    return [
        newest(f"_v_{position}").alias("last_finish_pos"), newest(f"_v_{time}").alias("last_finish_time_sec"),
        *[newest(f"_v_{c}").alias(f"last_{c}") for c in values], F.datediff(date, newest("_d")).alias("days_since_last_race"),
        of_five(position).alias("avg_finish_pos_5"), of_five(time).alias("avg_finish_time_sec_5"),
        F.coalesce(F.size(F.filter("_last", lambda x: x[f"_v_{position}"] == 1)).cast("long"), F.lit(0)).alias("wins_last_10"),
        F.when(F.col("_last").isNotNull(), F.size("_last")).otherwise(0).cast("long").alias("starts_last_10"),
    ]


def bucket_par_delta(target: DataFrame, history: DataFrame, entity: str, bucket: Sequence[str], date: str, available: str, as_of: str, value: str, name: str) -> DataFrame:
    """An entity's mean ``value`` over its known runs in the target's bucket, less the bucket's median of earlier years.

    Null values of a bucket column match each other; without such runs, or without earlier years, the delta is null.
    Rows without a value count in neither.
    """
    year = [f"_b{i}" for i in range(len(bucket))]
    same = [F.coalesce(F.col(b).cast("string"), F.lit("\0")).alias(y) for b, y in zip(bucket, year)]
    known = history.where(F.col(value).isNotNull()).select("*", *same, F.year(date).alias("_y"))
    asked = target.select("*", *same, F.year(date).alias("_y"))
    par = growing_median(known.select(*year, "_y", value), year, "_y", value, asked).select(*year, "_y", F.col("median").alias("_par"))
    sums = {"_s": F.col(value), "_c": F.lit(1)}
    own = prior_history(asked, known, entity, date, available, as_of, sums, group=year)
    # A row for each bucket and year; the target needn't move for it.
    out = own.join(F.broadcast(par), [*year, "_y"], "left").withColumn(name, F.try_divide("_s", "_c") - F.col("_par"))
    return out.select(*target.columns, name)


def work_features(target: DataFrame, works: DataFrame, entity: str, as_of: str, time: str, value: str, days: int = 30, ties: Sequence[str] = ()) -> DataFrame:
    """Latest, prior and best work in the last ``days``, their difference, the days since and the count."""
    w = works.where(F.col(value).isNotNull()).select(F.col(entity).alias("_e"), F.col(time).alias("_t"), F.col(value).alias("_v"), *[F.col(c).alias(f"_x_{c}") for c in ties])
    on = (F.col("_e") == F.col(entity)) & (F.col("_t") <= F.col(as_of)) & (F.col("_t") >= F.col(as_of) - F.expr(f"interval {days} days"))
    asked = target.select(entity, as_of).distinct()
    order = Window.partitionBy(entity, as_of).orderBy(F.desc("_t"), *[f"_x_{c}" for c in ties], "_v")
    ranked = asked.join(w, on).withColumn("_rn", F.row_number().over(order))
    pick = lambda k, c: F.max(F.when(F.col("_rn") == k, F.col(c)))
    agg = ranked.groupBy(entity, as_of).agg(pick(1, "_v").alias("work_recent"), pick(2, "_v").alias("work_prior"), F.min("_v").alias("work_best"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"))
    out = target.join(agg, [entity, as_of], "left")
    out = out.withColumn("work_accel", F.col("work_recent") - F.col("work_prior")).withColumn("days_since_work", F.datediff(F.col(as_of).cast("date"), F.col("_last").cast("date")))
    return out.withColumn("works_count", F.coalesce("_n", F.lit(0))).drop("_n", "_last")


def body_weight_features(now: Column, before: Column, carried: Column, extreme: float = 10.0) -> list[Column]:
    delta = F.when(before != 0, now - before)
    return [
        delta.alias("body_weight_delta_kg"), F.try_divide(delta, before).alias("body_weight_delta_pct"),
        F.when(now != 0, carried / now).alias("carried_to_body_weight_ratio"), F.coalesce(F.abs(delta) >= extreme, F.lit(False)).alias("extreme_body_weight_delta"),
    ]


def relationship_features(starts: Column, wins: Column, top3: Column, own: Column, other: Column) -> list[Column]:
    rate = F.try_divide(top3, starts)
    return [
        F.try_divide(wins, starts).alias("pair_win_rate"), rate.alias("pair_top3_rate"), (starts == 0).alias("first_time_pairing"),
        (rate - own).alias("pair_top3_lift_vs_horse"), (rate - other).alias("pair_top3_lift_vs_jockey"),
    ]


def travel_features(before: Column, now: Column, arrived: Column, source: Column) -> list[Column]:
    abroad = F.coalesce(before != now, F.lit(False))
    tier = F.when(source.isin("stable", "training_center", "manual"), "high").when(source == "unknown", "low").otherwise("medium")
    return [abroad.alias("international_travel"), F.when(abroad, arrived).alias("recovery_days_after_international"), tier.alias("travel_confidence")]


def validate_annotations(df: DataFrame, label: str, confidence: str, evidence: str) -> DataFrame:
    """``reject`` code per row (null if fine), and the confidence clamped to 0..1."""
    c = F.col(confidence)
    code = F.when(~F.col(label).isin(*PROXY_LABELS), "label").when(~c.between(0, 1), "confidence").when(F.coalesce(F.col(evidence), F.lit("")) == "", "evidence")
    return df.withColumn("reject", code).withColumn(confidence, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def smoothed_rate(wins: Column, n: Column, prior: Column, weight: float) -> Column:
    """Rate shrunk to ``prior`` as if by ``weight`` further rows."""
    return (wins + weight * prior) / (n + weight)


def _beta_losses(grid: Sequence[float], floor: float = 1e-12) -> Callable[[pa.RecordBatch], np.ndarray]:
    def f(batch: pa.RecordBatch) -> np.ndarray:
        ps, begin = lists(batch.column("ps"))
        most, least = numbers(batch.column("most")), numbers(batch.column("least"))
        out = np.empty((batch.num_rows, len(grid)))
        for j, b in enumerate(grid):
            x = np.maximum(most**b, least**b) / np.add.reduceat(ps**b, begin)
            out[:, j] = -np.log(np.fmax(x, floor))  # without a winner, the floor
        return out

    return f


def beta_losses(df: DataFrame, race: str, p: str, won: Column, grid: Sequence[float], compact: bool = False) -> DataFrame:
    """``(race, beta, loss)``: minus log of the winner's calibrated probability, for each beta of a grid.

    A race is one row with its probabilities until the grid is unfolded, after all shuffles; with ``compact`` that row is returned,
    for ``fit_beta_walkforward`` with a ``grid``.
    """
    q = F.greatest(F.col(p), F.lit(1e-12))
    of = F.when(won, q)
    races = df.groupBy(race).agg(F.array_sort(F.collect_list(q)).alias("ps"), F.max(of).alias("most"), F.min(of).alias("least"))
    return races if compact else over_grid(races, [race], _beta_losses(grid), grid, "beta", "loss")


def fit_beta_walkforward(
    losses: DataFrame, races: DataFrame, race: str, as_of: str, known: str, first: int = 20, window: int = 1000, every: int = 250, grid: Sequence[float] | None = None
) -> DataFrame:
    """``(race, n_history, beta)``: per race the beta fitted on results known by its decision time.

    History is ordered by (known, race). Its size n at a race fixes the fit: none below ``first``, a first fit there,
    and another whenever ``every`` more are known. ``losses`` has a row for each race and beta, or with ``grid`` the compact rows of
    ``beta_losses``; ``best_before`` sums them in blocks. The schedule reads the distinct sizes in order, a batch at a time.
    """
    done = races.where(F.col(known).isNotNull()).select(race, known)
    if grid is None:
        wide = stored(losses.groupBy(race).agg(F.array_sort(F.collect_list(F.struct("beta", "loss"))).alias("_c")), "losses")
        head = wide.select(F.col("_c.beta").alias("b")).first()
        grid = head["b"] if head else [1.0]
        rows, n = wide.select(race, F.col("_c.loss").alias("_c")), len(grid)
        f = lambda batch: lists(batch.column("_c"))[0].astype(float).reshape(-1, n)
    else:
        grid = sorted(grid)
        rows, f = losses, _beta_losses(grid)
    mean = lambda total, count: np.round(total / count[:, None], 12).argmin(axis=1)
    fits = best_before(done.join(rows, race), [known, race], race, window, f, grid, mean, "beta", current=True).select(F.col("n").alias("fit_n"), "beta")
    when = races.select(F.col(as_of).alias("_t"), F.lit(None).cast("long").alias("_k"), F.col(race).alias("_r")).withColumn("_side", F.lit(1))
    marks = races.where(F.col(known).isNotNull()).select(F.col(known).alias("_t"), F.lit(1).cast("long").alias("_k"), F.lit(None).cast(races.schema[race].dataType).alias("_r")).withColumn("_side", F.lit(0))
    # How many results are known by each race's time: counts per instant, then sums over instants.
    by_time = when.unionByName(marks).groupBy("_t").agg(F.count("_k").alias("c"))
    sizes = running_sum(by_time, ["_t"], F.col("c"), "n_history").select("_t", "n_history")
    sized = races.join(sizes, F.col(as_of) == F.col("_t")).select(race, as_of, "n_history")

    def schedule(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0
        for f in frames:
            out = []
            for n in f["n_history"]:
                if n >= first and (last < first or n - last >= every):
                    last = n
                out.append((n, last))
            yield pd.DataFrame(out, columns=["n_history", "fit_n"])

    steps = sized.select("n_history").distinct().repartition(1).sortWithinPartitions("n_history").mapInPandas(schedule, "n_history long, fit_n long")
    best = fits.join(F.broadcast(steps.select("fit_n").distinct()), "fit_n", "left_semi")
    return sized.join(steps, "n_history").join(best, "fit_n", "left").select(race, "n_history", F.coalesce("beta", F.lit(1.0)).alias("beta"))
