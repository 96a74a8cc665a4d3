"""Market probabilities and their movement: windows over a group (race), its items (runners) and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import asof_join

# Gates of the drift flag.
Z_LEAST, MOVE_LEAST, FIELD_LEAST, ODDS_MOST, MAD_TO_SD = 1.5, 0.08, 6, 900.0, 1.4826


def devig(df: DataFrame, group: Sequence[str], odds: str, name: str = "p") -> DataFrame:
    """Implied probabilities scaled to sum to one in each group; null for odds that aren't positive."""
    raw = F.when(F.col(odds) > 0, 1.0 / F.col(odds))
    return df.withColumn(name, raw / F.nullif(F.sum(raw).over(Window.partitionBy(*group)), F.lit(0.0)))


def snapshot_market(df: DataFrame, group: Sequence[str], odds: str, item: str) -> DataFrame:
    """Per (group, snapshot): overround, de-vigged probability, entropy and odds rank of every item."""
    w = Window.partitionBy(*group)
    out = df.withColumn("raw_prob", 1.0 / F.col(odds)).withColumn("overround", F.sum("raw_prob").over(w))
    out = out.withColumn("devigged_prob", F.col("raw_prob") / F.nullif(F.col("overround"), F.lit(0.0)))
    log = F.ln(F.greatest(F.col("devigged_prob"), F.lit(1e-12)))
    out = out.withColumn("market_entropy", 0.0 - F.sum(F.col("devigged_prob") * log).over(w))
    return out.withColumn("odds_rank", F.rank().over(w.orderBy(odds, item)))


def group_z(value: str, group: Sequence[str]) -> Column:
    """z within the group; 0 where the deviation is null or zero."""
    w = Window.partitionBy(*group)
    sd = F.stddev_samp(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)


def finish_percentile(position: str, group: Sequence[str]) -> Column:
    """1 for the first, 0 for the last of those that have a position; 1 in a field of one."""
    n = F.count(position).over(Window.partitionBy(*group))
    return F.when(F.col(position).isNull(), None).when(n <= 1, 1.0).otherwise(1.0 - (F.col(position) - 1) / (n - 1))


def normalised_rank(order: Sequence[Column | str], group: Sequence[str]) -> Column:
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    return F.when(n <= 1, 1.0).otherwise(1.0 - (F.row_number().over(w.orderBy(*order)) - 1) / (n - 1))


def softmax(score: str, group: Sequence[str]) -> Column:
    w = Window.partitionBy(*group)
    shifted = F.exp(F.col(score) - F.max(score).over(w))
    return shifted / F.sum(shifted).over(w)


def prior_sum(value: str | Column, group: Sequence[str], order: Sequence[Column | str], n: int) -> Column:
    """Sum over the ``n`` rows before the current one."""
    return F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(-n, -1))


def carry_first(value: str, group: Sequence[str], order: Sequence[Column | str]) -> Column:
    """The first non-null value so far."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def power_calibrate(p: str, beta: Column | float, group: Sequence[str]) -> Column:
    """p ** beta, scaled to sum to one in the group."""
    powered = F.pow(F.greatest(F.col(p), F.lit(1e-12)), beta if isinstance(beta, Column) else F.lit(float(beta)))
    return powered / F.sum(powered).over(Window.partitionBy(*group))


def residual_drift(df: DataFrame, group: Sequence[str], now: str, opening: str) -> DataFrame:
    """Items moving against their group: log move less the field's median, scaled by the MAD (else the deviation).

    Adds ``resid_pct``, ``drift_z`` and ``direction`` (null without a flag). The median is an aggregate joined
    back, so a large group isn't buffered by a window.
    """
    fine = (F.col(now) > 0) & (F.col(now) < ODDS_MOST) & (F.col(opening) > 0) & (F.col(opening) < ODDS_MOST)
    moved = df.withColumn("_d", F.when(fine, F.ln(F.col(now) / F.col(opening))))
    mid = moved.groupBy(*group).agg(F.median("_d").alias("_med"), F.count("_d").alias("_n"), F.stddev_pop("_d").alias("_sd"))
    off = moved.join(mid, list(group))
    mad = off.groupBy(*group).agg((F.median(F.abs(F.col("_d") - F.col("_med"))) * MAD_TO_SD).alias("_mad"))
    out = off.join(mad, list(group))
    scale = F.when(F.col("_mad") > 1e-6, F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1e-6)
    resid = F.col("_d") - F.col("_med")
    out = out.withColumn("resid_pct", F.exp(resid) - 1.0).withColumn("drift_z", resid / scale)
    flagged = (F.col("_n") >= FIELD_LEAST) & (F.abs("resid_pct") >= MOVE_LEAST) & (F.abs("drift_z") >= Z_LEAST)
    out = out.withColumn("direction", F.when(flagged, F.when(F.col("resid_pct") < 0, "firming").otherwise("draining")))
    return out.drop("_d", "_med", "_n", "_sd", "_mad")


def curve_features(
    odds: DataFrame, targets: DataFrame, group: str, item: str, time: str, price: str, post: str, minutes: Sequence[int]
) -> DataFrame:
    """Per (group, item, decision minute) what the odds curve showed by ``post`` less the minutes.

    Every snapshot carries the two before it, the first one, and the deviation and number so far; a decision then takes the
    latest snapshot as of its minute. ``targets`` (group, item, post) times the short list of minutes is small next to the curve.
    """
    snaps = snapshot_market(odds.where(F.col(price) > 0), [group, time], price, item)
    grid = targets.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in minutes])))
    grid = grid.withColumn("as_of", F.col(post) - F.make_dt_interval(mins=F.col("minutes")))
    values = ["odds_0", "log_0", "devigged_prob", "market_entropy", "odds_rank"]
    s = snaps.select(group, item, F.col(time).alias("at_0"), F.col(price).alias("odds_0"), F.ln(price).alias("log_0"), *values[2:])
    curve = Window.partitionBy(group, item).orderBy("at_0", *values)
    so_far = curve.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({
        "open": F.first(F.struct("odds_0", "odds_rank")).over(so_far), "odds_volatility": F.stddev_samp("log_0").over(so_far),
        "odds_snapshots_used": F.count("odds_0").over(so_far), **{f"{c}_{k}": F.lag(f"{c}_0", k).over(curve) for k in (1, 2) for c in ("at", "log")},
    })
    more = ["open", "odds_volatility", "odds_snapshots_used", "at_1", "log_1", "at_2", "log_2"]
    agg = asof_join(grid, s, [group, item], "as_of", "at_0", [*values, *more])
    gap = lambda k: (F.unix_micros(F.col(f"at_{k}").cast("timestamp")) - F.unix_micros(F.col(f"at_{k + 1}").cast("timestamp"))) / 60e6
    speed = lambda k: (F.col(f"log_{k}") - F.col(f"log_{k + 1}")) / gap(k)
    return agg.select(
        group, item, "minutes", "as_of", F.col("at_0").alias("max_source_available_at"), F.col("open.odds_0").alias("open_win_odds"),
        F.col("odds_0").alias("win_odds_at_t"), F.col("devigged_prob").alias("devigged_prob_at_t"),
        F.ln(F.col("odds_0") / F.col("open.odds_0")).alias("drift_open_to_t"), F.when(gap(0) > 0, speed(0)).alias("recent_velocity"),
        F.when((gap(0) > 0) & (gap(1) > 0), speed(0) - speed(1)).alias("recent_acceleration"), "odds_volatility",
        F.col("market_entropy").alias("market_entropy_at_t"), F.col("open.odds_rank").alias("open_odds_rank"), F.col("odds_rank").alias("odds_rank_at_t"),
        (F.col("open.odds_rank") - F.col("odds_rank")).alias("odds_rank_change"), F.coalesce("odds_snapshots_used", F.lit(0)).alias("odds_snapshots_used"),
    )
