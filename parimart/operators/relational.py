"""Deduplication, point-in-time joins, conditional aggregation, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from ..session import stored
from .histories import Question, ask_by_entity, by_length, known_sums

Keys = Sequence[str]


def running_sum(df: DataFrame, order: Keys, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one in ``order``, whose values should be unique.

    Rows are dealt by ranges of the order and stored, so that the ranges are chosen once. Each range is summed apart, and
    the totals of the ranges before it are added: no task holds more than one range.
    """
    rows = stored(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # One row per range.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_range").agg(F.sum("_v").alias("_s")).select("_range", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    within = F.sum("_v").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(before), "_range").withColumn(name, within + F.col("_s")).drop("_v", "_s", "_range")


def dedupe_latest(df: DataFrame, key: Keys, time: str, ties: Keys = ()) -> DataFrame:
    """One row per key: the latest ``time``, nulls last; ``ties`` decide among equals."""
    w = Window.partitionBy(*key).orderBy(F.col(time).desc_nulls_last(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_preferred(df: DataFrame, key: Keys, preference: Column, outcome: str, time: str, ties: Keys = ()) -> DataFrame:
    """One row per key: preferred source, then one with an outcome, then the latest, then ``ties``."""
    w = Window.partitionBy(*key).orderBy(preference, F.col(outcome).isNull(), F.col(time).desc_nulls_last(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def distinct_on(df: DataFrame, key: Keys, order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in ``order``."""
    return top_k(df, key, order, 1)


def top_k(df: DataFrame, key: Keys, order: Sequence[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes each partition to them before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn(rank or "_rn", F.row_number().over(w)).where(F.col(rank or "_rn") <= k)
    return out if rank else out.drop("_rn")


def resolve_source(preferred: DataFrame, fallback: DataFrame, key: Keys) -> DataFrame:
    """Rows of ``preferred``; rows of ``fallback`` whose key it doesn't have."""
    rest = fallback.join(preferred.select(*key).distinct(), list(key), "left_anti")
    return preferred.unionByName(rest, allowMissingColumns=True)


def coalesce_source(preferred: DataFrame, fallback: DataFrame, key: Keys, fill: Keys) -> DataFrame:
    """Full outer by key: values of ``preferred``, gaps in ``fill`` from ``fallback``."""
    b = fallback.select(*key, *[F.col(c).alias(f"_f_{c}") for c in fill])
    out = preferred.join(b, list(key), "full")
    return out.select(*key, *[F.coalesce(c, f"_f_{c}").alias(c) for c in fill])


def null_safe_join(left: DataFrame, right: DataFrame, key: Keys, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    names = {c: f"_r_{c}" for c in key}
    right = right.withColumnsRenamed(names)
    on = None
    for c, r in names.items():
        same = left[c].eqNullSafe(right[r])
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*names.values())


def optional_key_join(left: DataFrame, right: DataFrame, key: Keys, optional: str, how: str = "left") -> DataFrame:
    """Equi-join on ``key`` where the right side's ``optional`` must agree unless it is null."""
    names = {c: f"_r_{c}" for c in (*key, optional)}
    right = right.withColumnsRenamed(names)
    on = right[f"_r_{optional}"].isNull() | (right[f"_r_{optional}"] == left[optional])
    for c in key:
        on &= left[c] == right[f"_r_{c}"]
    return left.join(right, on, how).drop(*names.values())


def asof_join(left: DataFrame, right: DataFrame, key: Keys, left_time: str, right_time: str, values: Keys, lookback: str | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at ``right_time`` <= ``left_time`` (nulls if none).

    Both sides are stacked and one window carries the last right row forward: a sort per key, and no pairs
    are made however many right rows a key has. Ties in time go to the largest values. With ``lookback`` (an
    interval) an older row counts as none.
    """
    marked = left.select(
        *key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(_struct(right, right_time, values)).alias("_r"),
    )
    facts = right.where(F.col(right_time).isNotNull()).select(
        *key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
        F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_l"),
        F.struct(right_time, *values).alias("_r"),
    )
    w = Window.partitionBy(*key).orderBy(F.col("_t").asc_nulls_first(), "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = marked.unionByName(facts).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    hit = F.col("_t").isNotNull()
    if lookback:
        hit &= F.col(f"_r.{right_time}") >= F.col("_t") - F.expr(f"interval {lookback}")
    names = [right_time if right_time not in left.columns else f"{right_time}_right", *values]
    return out.select("_l.*", *[F.when(hit, F.col(f"_r.{c}")).alias(n) for c, n in zip([right_time, *values], names, strict=True)])


def _struct(df: DataFrame, time: str, values: Keys):
    return df.select(F.struct(time, *values).alias("s")).schema["s"].dataType


def nearest_in_time(left: DataFrame, right: DataFrame, key: Keys, left_time: str, right_time: str, values: Keys, lookback: str) -> DataFrame:
    """Each left row with the right row of its key nearest before it (within ``lookback``), or nulls."""
    return asof_join(left, right, key, left_time, right_time, values, lookback)


def prior_history(
    target: DataFrame, history: DataFrame, entity: str, date: str, available: str, as_of: str, sums: dict[str, Column],
    days: int | None = None, guard: Column | None = None, group: Keys = (),
) -> DataFrame:
    """Per target row totals over its entity's history before its date (and not more than ``days`` before) and known by ``as_of``.

    ``sums`` maps names to per-row columns; ``guard`` keeps placeholder entities out. The target's columns, then the sums
    (0 without history, or where a key, date or ``as_of`` is null). Rows and history meet once, by entity, and tasks answer
    (``known_sums``); entities with more history than a task may hold are answered by ``_history_blocks``.
    """
    if guard is not None:
        history = history.where(guard)
    names = [entity, *group]
    keys, totals = [f"_k{i}" for i in range(len(names))], [f"_s{i}" for i in range(len(sums))]
    facts = history.select(
        *[F.col(c).alias(k) for k, c in zip(keys, names)], F.col(date).alias("_d"), F.col(available).alias("_t"), *[c.alias(n) for n, c in zip(totals, sums.values())]
    ).dropna(subset=[*keys, "_d", "_t"])
    found = facts.agg(*[F.sum(n).alias(n) for n in totals]).schema
    facts = facts.withColumns({f.name: F.coalesce(F.col(f.name).cast(f.dataType), F.lit(0).cast(f.dataType)) for f in found})
    asked = {**dict(zip(keys, names)), "_d": date, "_t": as_of}
    since = {} if days is None else {"_since": (F.col("_d") - F.expr(f"interval {days} days")).cast(target.schema[date].dataType)}
    target, facts, long_target, long_facts = by_length(target, facts, keys, names)
    answer = known_sums(totals, "_since" if since else None)
    # Facts bring their sums under these names, answers come under others.
    answers = StructType([StructField(f"_a{f.name}", f.dataType) for f in found])
    out = ask_by_entity(target, asked, facts, keys, since, answer, answers)
    if long_target is not None:
        out = out.unionByName(_history_blocks(long_target, long_facts, asked, keys, totals, days).withColumnsRenamed({n: f"_a{n}" for n in totals}))
    return out.select(*target.columns, *[F.coalesce(f"_a{n}", F.lit(0)).alias(name) for n, name in zip(totals, sums, strict=True)])


def sums_question(
    entity: str, when: tuple[str, str, str], sums: dict[str, str], days: int | None, group: Keys = (), where: str | None = None, kinds: dict[str, DataType] | None = None
) -> Question:
    """``prior_history`` for ``ask_together``: ``sums`` maps names to columns without nulls, whole numbers unless ``kinds`` tells otherwise."""

    def apart(target: DataFrame, facts: DataFrame) -> DataFrame:
        return prior_history(target, facts, entity, *when, {n: F.col(c) for n, c in sums.items()}, days=days, group=group)

    found = StructType([StructField(n, (kinds or {}).get(n, LongType())) for n in sums])
    return Question(known_sums(list(sums.values()), None if days is None else "_since"), {c: c for c in sums.values()}, found, apart, group, 0, where)


def _history_blocks(target: DataFrame, facts: DataFrame, names: dict[str, str], keys: Keys, totals: Keys, days: int | None) -> DataFrame:
    """``prior_history`` without a bound on an entity's rows: the target's columns and ``totals`` (null without history).

    History is summed by (entity, date, available) and numbered by date, so that what lies between two dates is a range of
    numbers. A range is cut into at most two blocks of every power of two; a history row is in one block of each. Within a
    block one running sum in order of availability answers all that ask: n log n rows for n days, and no pairs.
    """
    known = [*keys, "_d", "_t"]
    facts = facts.groupBy(*known).agg(*[F.sum(n).alias(n) for n in totals]).withColumn("_fact", F.lit(1))
    asked = target.select(*[F.col(c).alias(n) for n, c in names.items()]).dropna().distinct().withColumn("_fact", F.lit(0))
    edges = asked.withColumn("_at", F.col("_d"))
    if days is not None:
        edges = asked.withColumn("_at", F.explode(F.array("_d", (F.col("_d") - F.expr(f"interval {days} days")).cast(asked.schema["_d"].dataType))))
    # Dates ask before they are facts, so that what is counted lies before them.
    stack = facts.withColumn("_at", F.col("_d")).unionByName(edges, allowMissingColumns=True)
    by_date = Window.partitionBy(*keys).orderBy("_at", "_fact", "_t").rowsBetween(Window.unboundedPreceding, 0)
    ranks = stored(stack.withColumn("_n", F.sum("_fact").over(by_date)), "ranks")
    low = F.lit(0).cast("long") if days is None else F.min("_n")
    ranges = ranks.where("_fact = 0").groupBy(*known).agg(low.alias("_lo"), F.max("_n").alias("_hi"))
    longest = ranges.agg(F.max(F.col("_hi") - F.col("_lo")).alias("n")).first()["n"] or 0
    levels = range(max(1, longest.bit_length()))

    def block(level: int, number: Column) -> Column:
        return F.struct(F.lit(level).alias("_level"), number.alias("_block"))

    wanted = []
    for k in levels:
        lo, hi = F.shiftright(F.col("_lo") + ((1 << k) - 1), k), F.shiftright("_hi", k)
        wanted += [F.when((lo < hi) & (lo % 2 == 1), block(k, lo)), F.when((lo < hi) & (hi % 2 == 1), block(k, hi - 1))]
    held = F.array(*[block(k, F.shiftright(F.col("_n") - 1, k)) for k in levels])
    asks = ranges.select(*known, F.lit(0).alias("_fact"), F.inline(F.array_compact(F.array(*wanted))))
    holds = ranks.where("_fact = 1").select(*known, "_fact", *totals, F.inline(held))
    by_time = Window.partitionBy(*keys, "_level", "_block").orderBy("_t", F.desc("_fact")).rowsBetween(Window.unboundedPreceding, 0)
    found = holds.unionByName(asks, allowMissingColumns=True).withColumns({n: F.sum(n).over(by_time) for n in totals})
    found = found.where("_fact = 0").groupBy(*known).agg(*[F.sum(n).alias(n) for n in totals])
    asking = target.select("*", *[F.col(c).alias(f"_q{n}") for n, c in names.items()])
    on = [F.col(f"_q{n}") == F.col(n) for n in known]
    return asking.join(found, on, "left").select(*target.columns, *totals)


def growing_median(history: DataFrame, key: Keys, year: str, value: str, asked: DataFrame | None = None, chunk: int = 1024) -> DataFrame:
    """``(key, year, median, n)``: for each ``asked`` key and year (or all that history has) the exact median of the values of
    earlier years, and their number; keys match null to null, without earlier values there is no row.

    A sketch of all values cuts them into chunks of about ``chunk`` or more, 256 chunks at most. Counts by key, chunk and year tell
    in which chunk the middle of what lies before a year is; only the rows of that chunk move. ``history`` is read three times.
    """
    rows = history.where(F.col(year).isNotNull() & F.col(value).isNotNull()).select(F.struct(*key).alias("_k"), F.col(year).alias("_y"), F.col(value).alias("_value"))
    near = F.col("_value").cast("double")
    sketch = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(near, [i / 256 for i in range(1, 256)], 10000).alias("e")).first()
    step = -(-256 // min(256, max(1, sketch["n"] // chunk)))
    ends = np.unique(np.array(sketch["e"] or [], float)[step - 1 :: step])
    # Values keep their order as doubles, and so do chunks.
    place = F.pandas_udf(lambda v: pd.Series(np.searchsorted(ends, v.to_numpy(dtype=float))), "int")
    placed = rows.withColumn("_chunk", place(near))
    years = F.collect_list(F.struct("_y", "_many"))
    by_chunk = placed.groupBy("_k", "_chunk", "_y").agg(F.count(F.lit(1)).alias("_many")).groupBy("_k", "_chunk").agg(years.alias("_years"))
    wanted = (placed if asked is None else asked.select(F.struct(*key).alias("_k"), F.col(year).alias("_y"))).select("_k", F.col("_y").alias("_asked")).distinct()
    before = F.aggregate(F.filter("_years", lambda x: x["_y"] < F.col("_asked")), F.lit(0).cast("long"), lambda n, x: n + x["_many"])
    counts = by_chunk.join(wanted, "_k").select("_k", "_asked", "_chunk", before.alias("_n")).where("_n > 0")
    of = Window.partitionBy("_k", "_asked")
    counts = counts.withColumns({"_to": F.sum("_n").over(of.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(of)})
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = counts.where((F.col("_to") - F.col("_n") <= high) & (F.col("_to") > low)).withColumn("_from", F.col("_to") - F.col("_n")).drop("_n", "_to")
    # Stored, so that its size is known: it is sent to the rows while it is small.
    again = placed.join(stored(middle, "middle"), ["_k", "_chunk"]).where(F.col("_y") < F.col("_asked"))
    again = again.groupBy("_k", "_asked", "_chunk", "_value", "_from", "_all").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.col("_from") + F.sum("_n").over(Window.partitionBy("_k", "_asked", "_chunk").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda k: F.max(F.when((F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto")), F.col("_value").cast("double")))
    found = again.withColumn("_upto", upto).groupBy("_k", "_asked", "_all").agg(((at(low) + at(high)) / 2).alias("median"))
    return found.select("_k.*", F.col("_asked").alias(year), "median", F.col("_all").alias("n"))


def split_stats(df: DataFrame, key: Keys, position: str) -> DataFrame:
    """Starts, wins, top-3 finishes and rates by ``key``; rows with a null key are left out."""
    for k in key:
        df = df.where(F.col(k).isNotNull())
    n = F.count(F.lit(1))
    wins, top3 = F.count_if(F.col(position) == 1), F.count_if(F.col(position) <= 3)
    return df.groupBy(*key).agg(
        n.alias("starts"), wins.alias("wins"), top3.alias("top3"), F.round(wins / n, 3).alias("win_pct"), F.round(top3 / n, 3).alias("top3_pct")
    )


def mad_z(df: DataFrame, key: Keys, value: str, name: str = "robust_z") -> DataFrame:
    """Robust z: distance from the key's median in units of 1.4826 times its median absolute deviation."""
    center = df.groupBy(*key).agg(F.median(value).alias("med"))
    off = df.join(center, list(key)).withColumn("_off", F.abs(F.col(value) - F.col("med")))
    spread = off.groupBy(*key).agg(F.median("_off").alias("mad"))
    return off.join(spread, list(key)).drop("_off").withColumn(name, F.try_divide(F.col(value) - F.col("med"), 1.4826 * F.col("mad")))


def binomial_z(df: DataFrame, key: Keys, hit: Column, baseline: float | Column, least: int) -> DataFrame:
    """z of each key's hit rate against ``baseline``, keys with ``least`` rows only; null at a baseline of 0 or 1."""
    n, wins = F.count(F.lit(1)), F.count_if(hit)
    out = df.groupBy(*key).agg(n.alias("n"), wins.alias("hits")).where(F.col("n") >= least)
    p = F.lit(baseline) if isinstance(baseline, float) else baseline
    return out.withColumn("rate", F.col("hits") / F.col("n")).withColumn("z", F.try_divide(F.col("hits") / F.col("n") - p, F.sqrt(p * (1 - p) / F.col("n"))))


def remove_top(df: DataFrame, key: Keys, value: str, n: int, ties: Keys = ()) -> DataFrame:
    """Rows without the ``n`` largest values of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(value), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > n).drop("_rn")


def reconcile(a: DataFrame, b: DataFrame, key: Keys, value: str) -> DataFrame:
    """Overlapping keys of two sources and how many of their values differ, one row."""
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), list(key))
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.agg(n.alias("overlap"), bad.alias("mismatches"), F.try_divide(bad, n).alias("mismatch_rate"))


def completeness_guard(counts: DataFrame, prior: DataFrame, key: Keys, floor: int = 6) -> DataFrame:
    """Counts per key against the high-water mark; a key may be published at the mark and the floor."""
    out = counts.join(prior, list(key), "left").withColumn("mark", F.greatest(F.coalesce("prior_n", F.lit(0)), F.lit(0)))
    ok = (F.col("n") >= F.col("mark")) & (F.col("n") >= floor)
    return out.select(*key, "n", "mark", ok.alias("publish"), F.greatest("n", "mark").alias("new_mark"))
