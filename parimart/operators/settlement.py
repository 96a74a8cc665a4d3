"""Settlement of selections and tickets against official outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .market import devig, residual_drift


def normalize_selection(selection: Column, pool: Column) -> Column:
    """Canonical combo text: two digits an item (one in bracket pools), order kept; canonical text passes through."""
    parts = F.filter(F.split(F.regexp_replace(selection, "-", " "), "\\s+"), lambda x: x != "")
    wide = F.array_join(F.transform(parts, lambda x: F.lpad(F.try_to_number(x, F.lit("999999")).cast("int").cast("string"), 2, "0")), "")
    one = F.array_join(F.transform(parts, lambda x: F.try_to_number(x, F.lit("999999")).cast("int").cast("string")), "")
    single = pool.isin("win", "place")
    joined = F.when(pool == "bracket_quinella", one).otherwise(wide)
    return F.when(single, F.slice(F.split(wide, "(?<=\\G..)"), 1, 1)[0]).when(F.size(parts) == 1, parts[0]).otherwise(joined)


def settle_bets(bets: DataFrame, payouts: DataFrame, starters: DataFrame, results: DataFrame) -> DataFrame:
    """Each bet with ``payout``, ``refund`` and ``reason``; payouts are per 100 of stake.

    The largest payout row of a combo counts. A win or place bet on a starter without a result is refunded, any
    other bet without a payout row is lost. Two joins settle every bet at once.
    """
    key = ["race_id", "pool", "combo"]
    official = payouts.groupBy(*key).agg(F.max("payout_yen").alias("official"))
    scratched = (
        starters.select("race_id", "runner").join(results.select("race_id", "runner"), ["race_id", "runner"], "left_anti")
        .distinct().select("race_id", F.lpad(F.col("runner").cast("string"), 2, "0").alias("combo"), F.lit(True).alias("scratched"))
    )
    out = bets.join(official, key, "left").join(scratched, ["race_id", "combo"], "left")
    back = F.col("official").isNull() & F.col("pool").isin("win", "place") & F.coalesce("scratched", F.lit(False))
    return out.select(
        *bets.columns,
        F.when(F.col("official").isNotNull(), F.bround(F.col("official") * F.col("stake") / 100).cast("long")).otherwise(0).alias("payout"),
        F.when(back, F.col("stake")).otherwise(0).alias("refund"),
        F.when(F.col("official").isNotNull(), "official_payout").when(back, "refund").otherwise("loss").alias("reason"),
    )


def build_result(placings: DataFrame, payouts: DataFrame, group: str = "race_id") -> DataFrame:
    """Placings by position as sorted sets and payouts as structs; groups without payouts aren't official."""
    by = placings.groupBy(group, "position").agg(F.sort_array(F.collect_set("runner")).alias("runners"))
    by = by.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("position", "runners"))).alias("placings"))
    pays = payouts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pool", "combo", "payout_yen"))).alias("payouts"))
    return by.join(pays, group)


def expand_placings(placings: DataFrame, group: str = "race_id", places: int = 3, most: int = 36) -> DataFrame:
    """All finishing orders that dead heats allow, ``(group, order)``, ``most`` a group.

    ``placings(group, position, runner)``: each position contributes one runner, positions in order.
    """
    out = None
    for k in range(1, places + 1):
        side = placings.where(F.col("position") == k).select(group, F.col("runner").alias(f"r{k}"))
        out = side if out is None else out.join(side, group, "left")
    order = F.filter(F.array(*[f"r{k}" for k in range(1, places + 1)]), lambda x: x.isNotNull())
    found = out.select(group, order.alias("order")).distinct()
    from .relational import top_k

    return top_k(found, [group], ["order"], most)


def line_hits(kind: Column, combo: Column, order: Column) -> Column:
    """Whether a line (array of items) wins for a finishing order: ordered, as a set, or as part of the first three."""
    top = lambda n: F.slice(order, 1, n)
    same_set = lambda n: (F.size(combo) == n) & (F.array_sort(combo) == F.array_sort(top(n)))
    hit = (
        F.when(kind.isin("exacta", "trifecta"), combo == F.slice(order, 1, F.size(combo)))
        .when(kind.isin("quinella", "bracket_quinella"), same_set(2))
        .when(kind == "trio", same_set(3))
        .when(kind == "wide", (F.size(combo) == 2) & (F.size(F.array_except(combo, top(3))) == 0))
        .otherwise(F.get(combo, F.lit(0)) == F.get(order, F.lit(0)))
    )
    return F.coalesce(hit & (F.size(combo) > 0) & (F.size(order) > 0), F.lit(False))


def resolve_tickets(lines: DataFrame, orders: DataFrame, payouts: DataFrame, scratches: DataFrame) -> DataFrame:
    """State and return of each ticket: open without a result, refunded if every line has a scratched item, won or miss.

    ``lines(ticket_id, race_id, type, combo, unit, est)``. All payout rows of a winning line are summed (dead heats),
    scaled from 100; without any the line's own estimate counts.
    """
    key = F.when(F.col("type").isin("exacta", "trifecta"), F.col("combo")).otherwise(F.array_sort("combo"))
    name = F.array_join(key.cast("array<string>"), "-")
    pay = payouts.groupBy("race_id", F.col("pool").alias("type"), F.col("combo").alias("name")).agg(F.sum("payout_yen").alias("yen"))
    gone = scratches.groupBy("race_id").agg(F.collect_set("runner").alias("gone"))
    known = orders.groupBy("race_id").agg(F.collect_list("order").alias("orders"))
    out = lines.withColumn("name", name).join(pay, ["race_id", "type", "name"], "left").join(known, "race_id", "left").join(gone, "race_id", "left")
    hit = F.exists("orders", lambda o: line_hits(F.col("type"), F.col("combo"), o))
    void = F.coalesce(F.size(F.array_intersect("combo", "gone")) > 0, F.lit(False))
    paid = F.when(F.col("yen").isNotNull(), F.col("yen") * F.col("unit") / 100).otherwise(F.col("est"))
    out = out.select("ticket_id", F.col("orders").isNull().alias("open"), void.alias("void"), F.coalesce(hit & ~void, F.lit(False)).alias("hit"), paid.alias("paid"), "unit")
    agg = out.groupBy("ticket_id").agg(
        F.bool_or("open").alias("open"), F.bool_and("void").alias("void"), F.bool_or("hit").alias("hit"),
        F.sum(F.when(F.col("hit"), F.col("paid")).otherwise(0.0)).alias("won"), F.sum("unit").alias("cost"),
    )
    state = F.when(F.col("open"), "open").when(F.col("void"), "refunded").when(F.col("hit"), "won").otherwise("miss")
    back = F.when(F.col("open"), None).when(F.col("void"), F.col("cost")).otherwise(F.col("won"))
    return agg.select("ticket_id", state.alias("state"), back.cast("double").alias("returned"))


def hash_result(placings: Column, payouts: Column) -> Column:
    """SHA-256 of a result whatever the order of its parts."""
    return F.sha2(F.to_json(F.struct(F.array_sort(placings).alias("p"), F.array_sort(payouts).alias("y"))), 256)


def freeze_curve(snaps: DataFrame, group: str, item: str, time: str, price: str, lead: str) -> DataFrame:
    """Open, decision and close odds per item with three de-vigged probabilities, drift flag and closing-line move.

    The decision is ``lead`` (interval) before the group's last snapshot.
    """
    fine = snaps.where(F.col(price) > 0)
    last = fine.groupBy(group).agg((F.max(time) - F.expr(f"interval {lead}")).alias("decision"))
    by = fine.join(last, group).groupBy(group, item).agg(
        F.min_by(price, time).alias("open_odds"), F.max_by(price, time).alias("close_odds"),
        F.max_by(F.when(F.col(time) <= F.col("decision"), F.col(price)), F.when(F.col(time) <= F.col("decision"), F.col(time))).alias("decision_odds"),
    )
    for a, b in (("open_odds", "p_open"), ("decision_odds", "p_decision"), ("close_odds", "p_close")):
        by = devig(by, [group], a, b)
    out = residual_drift(by, [group], "decision_odds", "open_odds")
    return out.withColumn("clv_logdrift", F.ln(F.col("close_odds") / F.col("decision_odds")))


def settle_curve(records: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Fill outcomes: a unit stake at the official final odds, the close where they are missing. Idempotent."""
    r = results.select(*key, F.col("finish_position").alias("_f"), F.col("final_odds").alias("_o"), F.lit(True).alias("_k"))
    price = F.coalesce(F.nullif(F.col("_o"), F.lit(0.0)), F.col("close_odds"))
    out = records.drop("finish_position", "won", "settle_odds", "settled_payout", "settled").join(r, key, "left")
    return out.select(
        *[c for c in out.columns if c not in ("_f", "_o", "_k")], F.col("_f").alias("finish_position"), (F.col("_f") == 1).alias("won"),
        F.when(F.col("_k"), price).alias("settle_odds"),
        F.when(F.col("_k") & price.isNotNull(), F.when(F.col("_f") == 1, price).otherwise(0.0)).alias("settled_payout"),
        F.coalesce("_k", F.lit(False)).alias("settled"),
    )
