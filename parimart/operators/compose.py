"""Larger jobs put together from the other operators: predictors, market tables, cards, sweeps, ticket scoring, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from ..sources.lake import read_csv, read_manifest, snapshot
from . import evaluate, features, histories, market, ordering, relational, settlement
from .marts import races_mart


def predictor(name: str) -> Callable[[], Column]:
    """Score columns by name: career rate, 1 / odds, calibrated or de-vigged probability, uniform."""
    return {
        "career": lambda: F.coalesce("career_win_rate", F.lit(0.0)), "odds": lambda: F.when(F.col("win_odds") > 0, 1.0 / F.col("win_odds")),
        "calibrated": lambda: F.col("calibrated_market_prob"), "devigged": lambda: F.col("p"), "uniform": lambda: F.lit(1.0),
    }[name]


def score_groups(df: DataFrame, group: str, item: str, f: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Scores by a user's own function of one group's rows; a group is a race, never a hot key.

    Groups are brought together and sorted, and tasks walk through them batch by batch: far less is spent on each group
    than when each is a frame of its own.
    """
    kinds = {k: v for k, v in df.dtypes}

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def aligned(score: pd.Series, g: pd.DataFrame) -> np.ndarray:
            return (score if score.index.equals(g.index) else score.reindex(g.index)).to_numpy(dtype=float)

        def scored(rows: pd.DataFrame) -> pd.DataFrame:
            # Slices of sorted rows, and one frame for all scores.
            keys = rows[group].to_numpy()
            begin = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            scores = [aligned(f(g), g) for g in (rows.iloc[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True))]
            return pd.DataFrame({group: keys, item: rows[item].to_numpy(), "score": np.concatenate(scores)})

        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            whole = rows[group] != rows[group].iloc[-1]
            if whole.any():
                yield scored(rows[whole])
            rest = rows[~whole]
        if rest is not None and len(rest):
            yield scored(rest)

    return df.repartition(group).sortWithinPartitions(group).mapInPandas(walk, f"{group} {kinds[group]}, {item} {kinds[item]}, score double")


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """SQL with ``{name}`` for tables and ``:name`` for values."""
    return spark.sql(text, args=args, **tables)


def market_probs(starts: DataFrame, race: str, item: str, odds: str, position: str, as_of: str, known: str, grid: Sequence[float], **fit) -> DataFrame:
    """De-vigged and walk-forward calibrated probabilities; what the fit used counts as a source."""
    p = market.devig(starts, [race], odds)
    races = starts.groupBy(race).agg(F.min(as_of).alias(as_of), F.max(known).alias(known))
    losses = features.beta_losses(p, race, "p", F.col(position) == 1, grid, compact=True)
    beta = features.fit_beta_walkforward(losses, races, race, as_of, known, grid=grid, **fit)
    out = p.join(beta, race).withColumn("market_beta", F.col("beta")).drop("beta", "n_history")
    return out.withColumn("calibrated_market_prob", market.power_calibrate("p", F.col("market_beta"), [race]))


#: Names of races of some standing.
GRADED_NAME = "(?i)(grade|g[123]|stakes|cup|記念|賞|sprint|derby|hope|hanshin|nakayama|tokyo|chukyo)"


def handicap_features(
    starts: DataFrame, days: int = 365, gold: Sequence[DataFrame] = (), guard: Column | None = None, turf: str = "turf", keep: Sequence[str] | None = None
) -> DataFrame:
    """Market-blind features: recent form, distance to the bucket's par of earlier years, rates of horse, trainer, jockey,
    trainer with jockey and jockey at the track over ``days``, body weight and field size.

    A run counts from its ``available_at`` on, and only after its own day. ``last_3f_seconds``, ``body_weight_kg`` and
    ``distance_m`` are used where ``starts`` has them; other columns known before the race pass through, or of these only
    ``keep`` beside the race and runner. ``gold`` holds tables of one row for each (race_id, runner), such as those of going and
    training, that are joined on. ``guard`` keeps placeholder horses out of the history of horses. ``surface_turf`` and, where
    there is a ``race_name``, ``is_filtered_name_match`` are 0 or 1.

    What is needed of ``starts`` is stored once, and its rows meet three times, by trainer, by jockey and by horse
    (``ask_together``): the widest answers come last and don't move. Buckets move as numbers, par is sent to the tasks.
    """
    kinds = dict(starts.dtypes)
    extra = [c for c in ("last_3f_seconds", "body_weight_kg") if c in kinds]
    bucket = [c for c in ("racecourse", "surface", "distance_m", "going_wetness") if c in kinds]
    deltas = {v: d for v, d in (("finish_time_seconds", "finish_time_par_delta"), ("last_3f_seconds", "last_3f_par_delta")) if v in kinds}
    # What the race itself brings out is no feature.
    outcome = ["finish_time_seconds", "last_3f_seconds", "finish_position", "available_at", "win_odds"]
    passing = [c for c in starts.columns if c not in outcome] if keep is None else list(dict.fromkeys(["race_id", "runner", *keep]))
    flags = {"surface_turf": F.col("surface") == turf}
    if "race_name" in kinds:
        flags["is_filtered_name_match"] = F.col("race_name").rlike(GRADED_NAME)
    # Field size and flags move as one number.
    size = F.count(F.lit(1)).over(Window.partitionBy("race_id"))
    marks = reduce(lambda m, v: m * 2 + F.coalesce(v.cast("int"), F.lit(0)), flags.values(), size).alias("_marks")
    only = None if guard is None else "_horse"
    facts = list(dict.fromkeys(["race_date", "available_at", "finish_position", *deltas, *extra]))
    base = list(dict.fromkeys([*passing, "horse_id", "trainer_id", "jockey_id", *bucket, *facts]))
    rows = stored(starts.select(*base, marks, *([] if guard is None else [guard.alias("_horse")])), "rows")
    long = {c: histories.long_entities(rows, [c]) for c in ("trainer_id", "jockey_id", "horse_id")}

    # A row for each bucket; its number tells that of the track, 0 for none.
    codes = stored(rows.select(*bucket).distinct(), "buckets")
    n = codes.count() + 1
    track = F.when(F.col("racecourse").isNotNull(), F.dense_rank().over(Window.orderBy("racecourse"))).otherwise(0)
    codes = codes.select(*bucket, (track.cast("long") * n + F.row_number().over(Window.orderBy(*bucket))).alias("_bucket"))
    rows = relational.null_safe_join(rows, F.broadcast(codes), bucket)
    # Times that are whole days move as dates, which compare alike.
    dates = [c for c in ("race_date", "available_at") if kinds[c].startswith("timestamp")]
    if len(dates) == 2 and rows.where(reduce(lambda x, y: x | y, [F.col(c) != F.col(c).cast("date").cast(kinds[c]) for c in dates])).isEmpty():
        rows = rows.withColumns({c: F.col(c).cast("date") for c in dates})
    horses = rows if guard is None else rows.where("_horse")
    asked, pars = rows.select("_bucket", F.year("race_date").alias("_y")), {}
    for v in deltas:
        par = relational.growing_median(horses.select("_bucket", F.year("race_date").alias("_y"), v), ["_bucket"], "_y", v, asked)
        pars[v] = stored(par.select("_bucket", "_y", F.col("median").alias(f"_par_{v}")), "par")

    when = ("race_date", "available_at", "race_date")
    one = {"_one": F.lit(1).cast("long"), "_won": F.coalesce((F.col("finish_position") == 1).cast("long"), F.lit(0)), "_placed": F.coalesce((F.col("finish_position") <= 3).cast("long"), F.lit(0))}
    roles = {
        "horse_id": {"horse": []}, "trainer_id": {"trainer": []},
        "jockey_id": {"jockey": [], "trainer_jockey_combo": ["trainer_id"], "jockey_track": ["_track"]},
    }

    def rates(entity: str, where: str | None = None) -> list[histories.Question]:
        return [relational.sums_question(entity, when, {f"_{r}_n": "_one", f"_{r}_w": "_won", f"_{r}_p": "_placed"}, days, group, where) for r, group in roles[entity].items()]

    last = list(dict.fromkeys([*passing, *facts, "horse_id", "_bucket", "_marks", *([] if guard is None else ["_horse"])]))
    out = histories.ask_together(rows, long["trainer_id"], "trainer_id", when, days, one, rates("trainer_id"), list(dict.fromkeys([*last, "trainer_id", "jockey_id"])))
    last += [n for q in rates("trainer_id") for n in q.found.names]
    at = {"_track": F.when(F.col("_bucket") >= n, F.floor(F.col("_bucket") / n))}
    out = histories.ask_together(out, long["jockey_id"], "jockey_id", when, days, one | at, rates("jockey_id"), last)
    last += [n for q in rates("jockey_id") for n in q.found.names]
    questions, values = [*rates("horse_id", only), features.form_question(out, "horse_id", when, ["finish_position", *facts[3:]], ["race_id", "runner"], only)], dict(one)
    for v in deltas:
        kind = rows.select(F.sum(v).alias("s")).schema["s"].dataType
        there = F.col(v).isNotNull() if guard is None else F.col(v).isNotNull() & F.col("_horse")
        values |= {f"_has_{v}": there, f"_sum_{v}": F.coalesce(F.col(v).cast(kind), F.lit(0).cast(kind))}
        questions.append(relational.sums_question("horse_id", when, {f"_s_{v}": f"_sum_{v}", f"_c_{v}": "_one"}, None, ["_bucket"], f"_has_{v}", {f"_s_{v}": kind}))
    out = histories.ask_together(out, long["horse_id"], "horse_id", when, days, values, questions, [c for c in last if c in passing or c in ("race_date", "body_weight_kg") or c not in facts])

    out = out.withColumn("_y", F.year("race_date"))
    for v in deltas:
        out = out.join(F.broadcast(pars[v]), ["_bucket", "_y"], "left")
    weight = [(F.col("body_weight_kg") - F.get("_last", F.lit(0))["_v_body_weight_kg"]).alias("body_weight_delta_vs_last")] if "body_weight_kg" in kinds else []
    form = features.form_columns(rows, "race_date", "finish_position", "finish_time_seconds", [c for c in extra if c != "body_weight_kg"])
    rate = lambda r, n: F.try_divide(F.col(f"_{r}_{n}"), F.col(f"_{r}_n"))
    out = out.select(
        *[F.col(c).cast(kinds[c]).alias(c) for c in passing], *form, *[(F.try_divide(f"_s_{v}", f"_c_{v}") - F.col(f"_par_{v}")).alias(d) for v, d in deltas.items()],
        *[c for of in roles.values() for r in of for c in (
            F.col(f"_{r}_n").alias(f"{r}_starts_{days}d"), rate(r, "w").alias(f"{r}_winrate_{days}d"), rate(r, "p").alias(f"{r}_top3rate_{days}d")
        )],
        *weight, F.shiftright("_marks", len(flags)).alias("field_size"),
        *[F.shiftright("_marks", len(flags) - i).bitwiseAND(1).cast("int").alias(c) for i, c in enumerate(flags, 1)],
    )
    for table in gold:
        out = out.join(table, ["race_id", "runner"], "left")
    return features.assert_market_blind(out, ["win_odds", "popularity", "devigged_market_prob"])


def settlement_equivalence(bets: DataFrame, a: DataFrame, b: DataFrame, starters: DataFrame, results: DataFrame) -> DataFrame:
    """Bets that two sources of payouts settle differently."""
    key = ["race_id", "pool", "combo", "stake"]
    x = settlement.settle_bets(bets, a, starters, results).select(*key, F.struct("payout", "refund", "reason").alias("x"))
    y = settlement.settle_bets(bets, b, starters, results).select(*key, F.struct("payout", "refund", "reason").alias("y"))
    return x.join(y, key, "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(*key, F.col("x.reason").alias("reason_a"), F.col("y.reason").alias("reason_b"))


def settle_sweep(tickets: DataFrame, resolved: DataFrame, stored: DataFrame, budget: int, archived: DataFrame | None = None) -> DataFrame:
    """Transitions of tickets, ``budget`` rows at most, oldest first in each of two passes.

    First those whose race is in the snapshot ``stored`` (race_id, hash): open ones, and settled ones whose result hash
    changed, by ``resolved`` (ticket_id, state, returned). Then open tickets of other races, by ``archived`` of the same
    columns. What is still open by then stays out. ``kind`` tells a first settlement from a change of state, of the
    amount or of the hash alone.
    """
    own = "returned" if "returned" in tickets.columns else None
    old = tickets.select("ticket_id", "race_id", "state", "seen_hash", (F.col(own) if own else F.lit(None)).cast("double").alias("_old"))
    here = old.join(stored.select("race_id", "hash"), "race_id").where((F.col("state") == "open") | ~F.col("hash").eqNullSafe(F.col("seen_hash"))).drop("hash")
    passes = [(here, resolved, "snapshot")]
    if archived is not None:
        passes.append((old.where("state = 'open'").join(stored.select("race_id"), "race_id", "left_anti"), archived, "archive"))
    out = None
    for i, (due, outcome, source) in enumerate(passes):
        new = outcome.select("ticket_id", F.col("state").alias("new_state"), F.col("returned").alias("new_returned"))
        part = due.join(new, "ticket_id").where("new_state <> 'open'").withColumns({"source": F.lit(source), "_pass": F.lit(i)})
        out = part if out is None else out.unionByName(part)
    same = F.col("_old").eqNullSafe(F.col("new_returned").cast("double"))
    kind = F.when(F.col("state") == "open", "settled").when(F.col("state") != F.col("new_state"), "state").when(~same, "amount").otherwise("hash")
    rows = out.withColumn("kind", kind).orderBy("_pass", "ticket_id").limit(budget)
    return rows.select("ticket_id", F.col("state").alias("old_state"), "new_state", "new_returned", "source", "kind")


def settle_model_card(card: DataFrame, score: str, payouts: DataFrame, starters: DataFrame, results: DataFrame, stake: int = 100) -> DataFrame:
    """Outcome of every runner, settlement of each race's top pick alone."""
    top = relational.top_k(card, ["race_id"], [F.desc(score), "runner"], 1)
    bets = top.select("race_id", F.lit("win").alias("pool"), F.lpad(F.col("runner").cast("string"), 2, "0").alias("combo"), F.lit(stake).alias("stake"), "runner")
    paid = settlement.settle_bets(bets, payouts, starters, results).select("race_id", "runner", F.col("payout").alias("pick_payout"), F.col("refund").alias("pick_refund"))
    out = card.join(results.select("race_id", "runner", F.col("finish_position").alias("final_position")), ["race_id", "runner"], "left")
    return out.join(paid, ["race_id", "runner"], "left").withColumn("won", F.col("final_position") == 1)


def pattern_of_life(odds: DataFrame, runs: DataFrame, roles: Sequence[str], bands: Sequence[float], z_most: float, least: int) -> DataFrame:
    """Connections whose runners plunge: robust z of the log move by odds band, then the flagged share against all."""
    band = F.lit(0)
    for b in bands:
        band += (F.col("close_odds") >= b).cast("int")
    moved = odds.withColumn("move", F.ln(F.col("close_odds") / F.col("open_odds"))).withColumn("band", band)
    z = relational.mad_z(moved, ["band"], "move").withColumn("plunge", F.coalesce(F.col("robust_z") <= -z_most, F.lit(False)))
    rows = runs.join(z.select("race_id", "runner", "plunge"), ["race_id", "runner"])
    rate = rows.agg(F.avg(F.col("plunge").cast("double")).alias("r")).first()["r"]
    out = None
    for role in roles:
        part = relational.binomial_z(rows, [role], F.col("plunge"), float(rate or 0.0), least).select(F.lit(role).alias("role"), F.col(role).alias("id"), "n", "hits", "z")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def wide_ticket_stats(lines: DataFrame, trio: DataFrame) -> DataFrame:
    """Per ticket of pairs: chance of a hit, expected winning lines and the best return, over all sets of first three."""
    pairs = F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))
    sets = trio.select("race_id", F.struct("a", "b", "c").alias("s"), "prob", F.explode(pairs).alias("x")).select("race_id", "s", "prob", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    won = lines.join(sets, ["race_id", "a", "b"]).groupBy("ticket", "race_id", "s").agg(F.first("prob").alias("p"), F.count(F.lit(1)).alias("n"), F.sum("payout").alias("y"))
    return won.groupBy("ticket").agg(F.sum("p").alias("hit_prob"), F.sum(F.col("p") * F.col("n")).alias("exp_lines"), F.max("y").alias("best_case"))


def score_combos(combos: DataFrame, marks: DataFrame, weights: dict[str, float], group: str) -> DataFrame:
    """Score of each pair: probability and log fair odds by weight, and a bonus for marked runners."""
    m = marks.select(group, F.col("item").alias("_i"), F.col("bonus").alias("_b"))
    out = combos
    for n in ("a", "b"):
        out = out.join(m.withColumnsRenamed({"_i": n, "_b": f"_b{n}"}), [group, n], "left")
    bonus = F.coalesce("_ba", F.lit(0.0)) + F.coalesce("_bb", F.lit(0.0))
    value = weights["prob"] * F.col("prob") + weights["odds"] * F.ln(1.0 / F.col("prob")) + weights["mark"] * bonus
    return out.withColumn("score", value).drop("_ba", "_bb")


#: Weights of the probability and of log fair odds by personality, and what marks add.
PERSONALITIES = {"safe": (7.0, 0.08), "balanced": (4.0, 0.35), "antiChalk": (4.0, 0.35), "longshot": (1.3, 0.95)}
MARKS = {"like": 0.25, "priceHorse": 0.3, "anchor": 0.35 + 0.15, "distrust": -0.3}


def score_styles(
    combos: DataFrame, probs: DataFrame, marks: DataFrame, styles: Sequence[tuple[str, str, str]], group: str, item: str, p: str, places: Sequence[str],
) -> DataFrame:
    """``score`` of every combination for each of ``styles`` (name, personality, flavour), with its ``tag`` (chalk, blend, value).

    To probability and log fair odds by personality come a share of 0.32 of the mean chance against (flavour value) or for it
    (chalk), penalties for favourites alone, for a balanced style a reward of 0.45 for a favourite with an outsider or else
    -0.3, and ``MARKS`` of ``marks`` (``group``, ``item``, mark). Favourites are the first third of the market, two at least,
    ties by item. Combinations with a runner marked avoid, or without every anchor of their race, are left out, as are those
    without a probability. A field comes to its combinations as one map: a single join, whatever the number of places.
    """
    w = Window.partitionBy(group)
    known = F.coalesce(F.col(p) > 0, F.lit(False))
    rank = F.row_number().over(w.orderBy(F.desc(known), F.desc(p), item))
    favourite = known & (rank <= F.greatest(F.lit(2), F.ceil(F.count_if(known).over(w) / 3)))
    bonus = reduce(lambda c, m: c.when(F.col("mark") == m[0], m[1]), MARKS.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    of = marks.select(group, item, "mark").distinct().groupBy(group, item).agg(
        F.sum(bonus).alias("bonus"), F.max((F.col("mark") == "avoid").cast("int")).alias("avoid"), F.max((F.col("mark") == "anchor").cast("int")).alias("anchor")
    )
    field = probs.where(F.col(item).isNotNull()).select(group, item, F.when(known, F.col(p)).otherwise(0.0).alias("p"), favourite.cast("int").alias("fav")).join(of, [group, item], "full")
    names = {"p": 0.0, "fav": 0, "bonus": 0.0, "avoid": 0, "anchor": 0}
    entry = F.struct(F.col(item), F.struct(*[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in names.items()]))
    fields = field.where(F.col(item).isNotNull()).groupBy(group).agg(F.map_from_entries(F.collect_list(entry)).alias("_field"), F.sum(F.coalesce("anchor", F.lit(0))).alias("_anchors"))
    rows = combos.where("prob > 0").join(fields, group, "left")
    total = lambda c: reduce(lambda x, y: x + y, [F.coalesce(F.try_element_at("_field", F.col(n))[c], F.lit(names[c])) for n in places])
    rows = rows.withColumns({f"_{c}": total(c) for c in names}).where((F.col("_avoid") == 0) & (F.col("_anchor") == F.coalesce("_anchors", F.lit(0))))
    k = len(places)
    rows = rows.withColumn("tag", F.when(F.col("_fav") == k, "chalk").when(F.col("_fav") == 0, "value").otherwise("blend"))
    options = F.array(*[F.struct(F.lit(n).alias("style"), F.lit(who).alias("who"), F.lit(flavour).alias("flavour"), *[F.lit(v).alias(c) for v, c in zip(PERSONALITIES[who], ("hit", "pay"), strict=True)]) for n, who, flavour in styles])
    rows = rows.withColumn("_s", F.explode(options))
    who, flavour, against = F.col("_s.who"), F.col("_s.flavour"), 1 - F.col("_p") / k
    score = F.col("prob") * F.col("_s.hit") + F.ln(F.greatest(F.lit(1.0), 1.0 / F.col("prob"))) * F.col("_s.pay") + F.col("_bonus")
    score += F.when(flavour == "value", against * 0.32).when(flavour == "chalk", (1 - against) * 0.32).otherwise(0.0)
    chalk = F.col("tag") == "chalk"
    score -= F.when(chalk & (who == "antiChalk"), 0.55).otherwise(0.0) + F.when(chalk & (who != "safe"), 0.25).otherwise(0.0)
    score += F.when(who != "balanced", 0.0).when(F.col("tag") == "blend", 0.45).otherwise(-0.3)
    return rows.select(*combos.columns, F.col("_s.style").alias("style"), "tag", score.alias("score"))


def trim_lines(scored: DataFrame, ticket: Sequence[str], item: Sequence[str], unit: float, most: int) -> DataFrame:
    """Best-scored lines of a ticket as long as the best return exceeds the cost, ``most`` at most."""
    w = Window.partitionBy(*ticket).orderBy(F.desc("score"), *item).rowsBetween(Window.unboundedPreceding, 0)
    rows = scored.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_best", F.max("est_payout").over(w) * unit)
    rows = rows.withColumn("_bad", F.max(((F.col("_best") <= F.col("_n") * unit) | (F.col("_n") > most)).cast("int")).over(w))
    return rows.where("_bad = 0").drop("_n", "_best", "_bad")


def rank_tickets(tickets: DataFrame, group: str, kind: str, score: str, k: int = 3) -> DataFrame:
    """The best ticket of each kind, then the best ``k`` of those."""
    one = relational.top_k(tickets, [group, kind], [F.desc(score), kind], 1)
    return relational.top_k(one, [group], [F.desc(score), kind], k, "place")


def exotic_calibration(combos: DataFrame, winners: DataFrame, group: str, item: Sequence[str], bins: int = 10) -> DataFrame:
    """Combination probabilities in bins of their logarithm: rows, mean, hits."""
    won = winners.select(group, *item).withColumn("_w", F.lit(1))
    rows = combos.where("prob > 0").join(won, [group, *item], "left").withColumn("bin", F.least(F.lit(bins - 1), F.floor(-F.log10("prob") * 2)).cast("int"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"), F.count("_w").alias("hits"))


def exotic_likelihood(probs: DataFrame, winners: DataFrame, group: str, item: str, p: str, pools: dict[str, Sequence[str]], gamma: float | Column) -> DataFrame:
    """A row per pool: ``races`` with a winning selection, their ``combos``, and the log-likelihood of what won by the model
    without (``harville_ll``) and with the exponent ``gamma`` (``henery_ll``), a number or each group's column.

    ``pools`` has the columns of ``winners`` that make up a pool's winning selection, in the order of its items; selections that
    a model gives no chance count for nothing, and chances below 1e-12 as that.
    """
    return ordering.pool_likelihood(probs, winners, group, item, p, pools, gamma)


def realized_edge(probs: DataFrame, payouts: DataFrame, key: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Model probability against 100 / payout of what won, by payout bucket."""
    rows = probs.join(payouts, list(key)).withColumn("implied", 100.0 / F.col("payout_yen")).withColumn("bucket", evaluate.binned(F.col("payout_yen"), edges))
    ratio = F.col("prob") / F.col("implied")
    return rows.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("mean_edge"), F.median(ratio).alias("median_edge"), F.avg(F.ln(ratio)).alias("log_edge"))


def exotic_efficiency(model: DataFrame, quoted: DataFrame, payouts: DataFrame, key: Sequence[str], odds: str, taus: Sequence[float], capacity: float = 0.0) -> DataFrame:
    """Bets where the model's probability is ``tau`` times the quoted one, settled once, for each tau."""
    rows = model.join(quoted, list(key)).join(payouts, list(key), "left")
    rows = rows.withColumn("ratio", F.col("prob") * F.col(odds)).withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in taus]))).where("ratio >= tau")
    back = F.sum(F.coalesce("payout_yen", F.lit(0)) / 100.0) * (1.0 - capacity)
    return rows.groupBy("tau").agg(F.count(F.lit(1)).alias("bets"), back.alias("returned"), (back / F.count(F.lit(1)) - 1).alias("roi"))


def stability(fits: DataFrame, year: Column, value: str) -> DataFrame:
    """A fitted parameter by year."""
    return fits.groupBy(year.alias("year")).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))


def cells(df: DataFrame, flags: dict[str, Column], measures: Sequence[Column], least: int) -> DataFrame:
    """Measures in each of several overlapping cells, with a reason where a cell is thin."""
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())
    out = df.withColumn("cell", F.explode(tags)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *measures)
    return out.withColumn("reason", F.when(F.col("n") < least, "thin"))


def per_group(df: DataFrame, key: Sequence[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One call of ``work`` for the rows of each group, for what columns can't express; a group must fit a task."""
    return df.groupBy(*key).applyInPandas(work, schema)


def grid_best(df: DataFrame, key: Sequence[str], grid: Sequence[float], loss: Callable[[Column], Column]) -> DataFrame:
    """The value of a short grid with the least summed loss in each group, ties to the smallest; losses are summed before
    they are shuffled."""
    tried = df.withColumn("_g", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    sums = tried.groupBy(*key, "_g").agg(F.sum(loss(F.col("_g"))).alias("loss"))
    return sums.groupBy(*key).agg(F.min(F.struct("loss", "_g")).alias("b")).select(*key, F.col("b._g").alias("best"), "b.loss")


def day_pipeline(spark: SparkSession, folder: str, lake: str, schema: str, race: str, position: str) -> DataFrame:
    """CSV files of one day through all layers, with the rows of each: snapshot, typed rows, features, mart."""
    taken = snapshot(spark, folder, f"{lake}/bronze")
    silver = read_csv(spark, folder, schema)
    silver.write.mode("overwrite").parquet(f"{lake}/silver/{taken}")
    silver = spark.read.parquet(f"{lake}/silver/{taken}")
    gold = silver.withColumn("field", F.count(F.lit(1)).over(Window.partitionBy(race)))
    gold.write.mode("overwrite").parquet(f"{lake}/gold/{taken}")
    mart = races_mart(spark.read.parquet(f"{lake}/gold/{taken}"), race, [], position)
    layers = (("bronze_files", read_manifest(spark, f"{lake}/bronze/{taken}")), ("silver", silver), ("gold", gold), ("mart", mart))
    out = None
    for name, rows in layers:
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def validate_features(
    df: DataFrame, race: str, date: str, p: str, base: Sequence[str], extra: Sequence[str], odds: str, won: Column, z: Sequence[str] = (), since: int = 2023,
    share: float = 0.7, top: float = 0.75, subsets: dict[str, Column] | None = None, draws: int = evaluate.DRAWS, least: int = 50, takeout: float = 0.23,
) -> DataFrame:
    """What ``extra`` features add to ``base`` ones on races that neither fit has seen: a row for each of ``subsets``.

    The first ``share`` of each era's races (before the year ``since``, and from it on) fit both logistic models, with ``z``
    columns taken within the race as ``<name>_z`` and missing values as 0. Of the others come the mean loss per winner of both,
    and the runners, hit rate and return of the quarter (from quantile ``top`` of all of them) whose enhanced probability exceeds
    ``p`` most. The loss's change and the return have 95 % intervals over resampled dates, ``draws`` of them. ``subsets`` name
    conditions on the tested runners, such as a kind of course; one with fewer than ``least`` runners has no row. The default is
    ``all``. ``verdict`` is edge if the loss falls for sure and the return is above that of ``takeout``, harm if it rises, else
    inconclusive.
    """
    used = [*base, *extra]
    rows = df.withColumns({f"{c}_z": market.group_z(c, [race]) for c in z}).withColumn("_y", F.coalesce(won.cast("double"), F.lit(0.0)))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used})
    parts = {f"_in{k}": (label, condition) for k, (label, condition) in enumerate((subsets or {"all": F.lit(True)}).items())}
    kept = list(dict.fromkeys([race, date, p, odds, "_y", *used]))
    # Stored before eras are split, which reads it too: features are computed once.
    rows = stored(rows.select(*kept, *[condition.alias(n) for n, (_, condition) in parts.items()]), "features")
    split = evaluate.era_split(rows.select(race, date).distinct(), F.year(date) >= since, [date, race]).select(race, "split")
    rows = stored(rows.join(split, race), "validation")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    for name, columns in (("baseline", base), ("enhanced", used)):
        test = evaluate.fit_logit_probs(train, test, columns, "_y", [race]).withColumnRenamed("model_prob", f"{name}_prob")
    test = stored(test.withColumn("_d", F.col("enhanced_prob") / F.greatest(F.col(p), F.lit(1e-9))), "validated")
    cut = evaluate.quantile(test, "_d", top, "_cut")
    test = test.join(F.broadcast(cut), how="left")
    wins, one = F.col("_y") > 0, F.lit(1.0)
    nll = lambda n: -F.ln(F.greatest(F.col(f"{n}_prob"), F.lit(1e-12)))
    loss = [(F.sum(F.when(wins, nll(n))) / F.count_if(wins)).alias(f"{n}_log_loss") for n in ("baseline", "enhanced")]
    hit, back = F.col("_d") >= F.col("_cut"), F.when(wins, F.coalesce(F.col(odds), F.lit(0.0))).otherwise(0.0) - 1
    out = None
    for n, (label, _) in parts.items():
        part = test.where(n)
        sums = part.agg(
            F.countDistinct(race).alias("races"), F.count(F.lit(1)).alias("runners"), *loss, F.count_if(hit).alias("stakes"),
            F.avg(F.when(hit, F.col("_y"))).alias("hit_rate"), F.avg(F.when(hit, back)).alias("roi"),
        ).where(F.col("runners") >= least)
        for name, picked, value in (("delta", wins, nll("enhanced") - nll("baseline")), ("roi", hit, back)):
            dated = part.where(picked).select(date, value.alias("_a"), one.alias("_b"))
            ends = evaluate.cluster_bootstrap(dated, date, "_a", "_b", draws).select(F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))
            sums = sums.join(F.broadcast(ends), how="left")  # both are one row
        sums = sums.select(F.lit(label).alias("subset"), "*")
        out = sums if out is None else out.unionByName(sums)
    sure = F.when((F.col("delta_hi") < 0) & (F.col("roi_lo") > -takeout), "edge").when(F.col("delta_lo") > 0, "harm").otherwise("inconclusive")
    return out.withColumns({"delta_log_loss": F.col("enhanced_log_loss") - F.col("baseline_log_loss"), "verdict": sure})


def fold_groups(
    df: DataFrame, key: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], object],
    finish: Callable[[tuple, object], pd.DataFrame], schema: str,
) -> DataFrame:
    """Walk each group's rows in ``order`` without holding it: batch by batch through ``step``, which takes the state that
    ``start`` gave and the next rows of the group and returns the new state; ``finish`` makes the group's rows of the last one.

    Rows are dealt by key and sorted; a group may be any number of batches long, and only its state goes from one to the next.
    Null keys are a group.
    """

    def same(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        return ((a.to_numpy() == b.to_numpy()) | (a.isna().to_numpy() & b.isna().to_numpy())).all(axis=1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for f in frames:
            if not len(f):
                continue
            keys = f[list(key)]
            new = np.concatenate([[last is None or not same(keys[:1], last)[0]], ~same(keys[1:], keys[:-1])])
            at = np.flatnonzero(new)
            for a, b in zip([0, *at[at > 0]], [*at[at > 0], len(f)], strict=True):
                if new[a]:
                    if last is not None:
                        yield finish(tuple(last.iloc[0]), state)
                    state = start()
                state = step(state, f[a:b])
                last = keys[b - 1 : b]
        if last is not None:
            yield finish(tuple(last.iloc[0]), state)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)
