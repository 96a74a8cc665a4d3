"""Marts, cards and live views: grouped rows with nested parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iso_week

from .relational import top_k


def _rates(position: str) -> list[Column]:
    n = F.count(F.lit(1))
    wins, top3 = F.count_if(F.col(position) == 1), F.count_if(F.col(position) <= 3)
    return [n.alias("starts"), wins.alias("wins"), top3.alias("top3"), F.bround(wins / n, 3).alias("win_pct"), F.bround(top3 / n, 3).alias("top3_pct")]


def races_mart(starts: DataFrame, race: str, carry: Sequence[str], position: str) -> DataFrame:
    """A row per race with field size and whether it has results."""
    return starts.groupBy(race, *carry).agg(F.count(F.lit(1)).alias("field_size"), F.bool_or(F.col(position).isNotNull()).alias("has_results"))


def form_card(history: DataFrame, entity: str, as_of: Column, time: str, order: Sequence[Column | str], position: str, splits: Sequence[str], recent: int = 8, carry: Sequence[str] = ()) -> DataFrame:
    """One nested card per entity from what was known before ``as_of``: career, splits by key, recent rows.

    All entities at once: each part is a grouped aggregate, joined by entity at the end.
    """
    past = history.where(F.col(time) < as_of)
    card = past.groupBy(entity).agg(F.struct(*_rates(position)).alias("career"))
    for s in splits:
        by = past.where(F.col(s).isNotNull()).groupBy(entity, s).agg(F.struct(*_rates(position)).alias("v"))
        card = card.join(by.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(s).cast("string"), "v")))).alias(f"by_{s}")), entity, "left")
    last = top_k(past, [entity], order, recent, "_k")
    rows = last.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_k", time, position, *carry))).alias("recent"))
    return card.join(rows, entity, "left")


def card_for_races(targets: DataFrame, history: DataFrame, entity: str, race: str, as_of: str, time: str, position: str) -> DataFrame:
    """Career of every runner of a race as of the race's own time; history is summed by instant before the join."""
    by = history.groupBy(F.col(entity).alias("_e"), F.col(time).alias("_t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(position) == 1).alias("w"), F.count_if(F.col(position) <= 3).alias("k"))
    asked = targets.select(entity, as_of).distinct()
    got = asked.join(by, (F.col("_e") == F.col(entity)) & (F.col("_t") < F.col(as_of))).groupBy(entity, as_of).agg(F.sum("n").alias("starts"), F.sum("w").alias("wins"), F.sum("k").alias("top3"))
    out = targets.select(race, entity, as_of).distinct().join(got, [entity, as_of], "left")
    return out.withColumn("status", F.when(F.col("starts").isNull(), "no_history").otherwise("ok"))


def live_snapshot(entries: DataFrame, odds: DataFrame, results: DataFrame, race: str, item: str) -> DataFrame:
    """A row per race: its status (registered, open, result), runners with their own, and counts."""
    o = odds.select(race, item, "win_odds")
    r = results.select(race, item, "finish_position")
    rows = entries.select(race, item).join(o, [race, item], "left").join(r, [race, item], "left")
    state = F.when(F.col("finish_position").isNotNull(), "result").when(F.col("win_odds").isNotNull(), "open").otherwise("registered")
    rows = rows.withColumn("state", state)
    by = rows.groupBy(race).agg(F.array_sort(F.collect_list(F.struct(item, "state", "win_odds"))).alias("runners"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("state") == "result", 2).when(F.col("state") == "open", 1).otherwise(0)).alias("_s"))
    return by.withColumn("status", F.when(F.col("_s") == 2, "result").when(F.col("_s") == 1, "open").otherwise("registered")).drop("_s")


def market_shape(probs: DataFrame, race: str, p: str, item: str) -> DataFrame:
    """Favourite's probability, concentration of the first three, and a class.

    The class is taken from values of 12 places, so that it doesn't depend on the order in which they were summed.
    """
    top = top_k(probs.where(F.col(p) > 0), [race], [F.desc(F.round(p, 12)), item], 3)
    by = top.groupBy(race).agg(F.max(p).alias("favourite"), F.sum(p).alias("top3"))
    at_least = lambda c, least: F.round(c, 12) >= least
    return by.withColumn("shape", F.when(at_least("favourite", 0.4), "dominant").when(at_least("top3", 0.65), "concentrated").otherwise("open"))


def counted_class(rows: DataFrame, race: str, style: str, front: Sequence[str], closers: Sequence[str]) -> DataFrame:
    """Pace class from the number of front runners and closers."""
    by = rows.groupBy(race).agg(F.count_if(F.col(style).isin(*front)).alias("front"), F.count_if(F.col(style).isin(*closers)).alias("closers"))
    return by.withColumn("pace", F.when(F.col("front") >= 3, "fast").when(F.col("front") == 0, "slow").otherwise("even"))


def contender_groups(rows: DataFrame, race: str, item: str, odds: str, caps: tuple[int, int, int] = (5, 5, 4)) -> DataFrame:
    """Core (odds to 6), challenger (to 20) and outsider tiers, the shortest of each up to its cap."""
    tier = F.when(F.col(odds) <= 6, "core").when(F.col(odds) <= 20, "challenger").otherwise("outsider")
    out = top_k(rows.where(F.col(odds) > 0).withColumn("tier", tier), [race, "tier"], [odds, item], max(caps), "place")
    cap = F.when(F.col("tier") == "core", caps[0]).when(F.col("tier") == "challenger", caps[1]).otherwise(caps[2])
    return out.where(F.col("place") <= cap)


def nested_by(rows: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Rows gathered under their key as an ordered array of structs."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))


def latest_edition(rows: DataFrame, key: str) -> DataFrame:
    """All rows of the largest key; the key is a scalar, so nothing is sorted."""
    top = rows.agg(F.max(key).alias("_top"))
    return rows.join(F.broadcast(top), F.col(key) == F.col("_top")).drop("_top")


def select_card(races: DataFrame, *predicates: Column, time: str, key: str) -> DataFrame:
    """Races that all predicates hold for, by post time with unknown times last."""
    for p in predicates:
        races = races.where(p)
    return races.orderBy(F.col(time).asc_nulls_last(), key)


def ranked_upcoming(races: DataFrame, day: str, now: Column, rank: Column, key: str, limit: int) -> DataFrame:
    return races.where(F.col(day) >= now).withColumn("rank", rank).where("rank is not null").orderBy("rank", day, key).limit(limit)


def argmax_picks(rows: DataFrame, picks: dict[str, Column], key: str) -> DataFrame:
    """One row: for each pick the key of the row with the largest value, ties to the smallest key."""
    return rows.agg(*[F.max_by(key, F.struct(v, -F.col(key))).alias(n) for n, v in picks.items()])


def publish_rows(rows: DataFrame, flags: Sequence[str], times: Sequence[str]) -> DataFrame:
    """For a serving table: booleans as 0 and 1, times as ISO text."""
    return rows.withColumns({**{c: F.col(c).cast("int") for c in flags}, **{c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in times}})


def freeze_model_card(scores: DataFrame, race: str, item: str, score: str, snapshots: DataFrame, time: str, decided: str) -> DataFrame:
    """Scores scaled to sum to one in the race (uniform if they can't be), fair odds, and whether the decision came before
    the first snapshot."""
    w = Window.partitionBy(race)
    total = F.sum(F.when(F.col(score) > 0, F.col(score))).over(w)
    p = F.when(total > 0, F.coalesce(F.when(F.col(score) > 0, F.col(score)), F.lit(0.0)) / total).otherwise(1.0 / F.count(F.lit(1)).over(w))
    first = snapshots.groupBy(race).agg(F.min(time).alias("_first"))
    out = scores.withColumn("model_prob", p).join(first, race, "left")
    out = out.withColumn("fair_odds", F.when(F.col("model_prob") > 0, 1.0 / F.col("model_prob")))
    return out.withColumn("pre_market", F.col("_first").isNull() | (F.col(decided) < F.col("_first"))).drop("_first")


def live_edition(races: DataFrame, snapshots: DataFrame, race: str, grade: str, day: str, time: str, now: Column, fresh: int = 20) -> DataFrame:
    """Graded races with the ISO week of their day as edition key, the age of the newest snapshot in minutes, and whether it
    is ``live`` (``fresh`` minutes at most), ``stale`` or ``missing``; ``stamped_at`` is ``now`` for live ones alone."""
    newest = snapshots.groupBy(race).agg(F.max(time).alias("_newest"))
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col("_newest").cast("timestamp"))) / 60.0
    out = races.where(F.col(grade).isNotNull()).join(newest, race, "left").withColumn("age_minutes", age)
    state = F.when(F.col("age_minutes").isNull(), "missing").when(F.col("age_minutes") <= fresh, "live").otherwise("stale")
    out = out.withColumn("edition_key", iso_week(F.col(day))).withColumn("freshness", state)
    return out.withColumn("stamped_at", F.when(F.col("freshness") == "live", now)).drop("_newest")


def rolling_edition(stored: DataFrame, edition: DataFrame, key: str, reserved: int = 90) -> DataFrame:
    """Stored editions with the reserved version of each key replaced by the live one; stale editions change nothing."""
    live = edition.where("freshness = 'live'").withColumn("version", F.lit(reserved)).select(*stored.columns)
    kept = stored.join(live.select(key, "version").distinct(), [key, "version"], "left_anti")
    return kept.select(*stored.columns).unionByName(live)
