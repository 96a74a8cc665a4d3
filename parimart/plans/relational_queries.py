"""Queries over sections: dedupe (B), joins (C), aggregation (D), top-k and set operations (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .bindings import Tables
from .registry import query

WIN = "sum(case when finish_position = 1 then 1 else 0 end)"
TOP3 = "sum(case when finish_position <= 3 then 1 else 0 end)"


@query("B12_dedupe_latest", """
    select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice from (
      select *, row_number() over (partition by l_orderkey, l_linenumber
        order by l_shipdate desc nulls last, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn = 1""")  # fmt: skip
def b12(t: Tables) -> DataFrame:
    out = R.dedupe_latest(t.lineitem, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice")


@query("B13_dedupe_preferred", """
    select l_orderkey, l_linenumber, l_returnflag, l_shipdate, l_extendedprice from (
      select *, row_number() over (partition by l_orderkey, l_linenumber
        order by case when l_returnflag = 'R' then 0 else 1 end, case when l_discount is null then 1 else 0 end,
                 l_shipdate desc nulls last, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn = 1""")  # fmt: skip
def b13(t: Tables) -> DataFrame:
    pref = F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    out = R.dedupe_preferred(t.lineitem, ["l_orderkey", "l_linenumber"], pref, "l_discount", "l_shipdate", ["l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_extendedprice")


@query("B14_distinct_on", """
    select o_custkey, o_orderkey, o_orderdate from (
      select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1""")  # fmt: skip
def b14(t: Tables) -> DataFrame:
    return R.distinct_on(t.orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


def _two(t: Tables) -> tuple[DataFrame, DataFrame]:
    by = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_partkey").alias("part"))
    return tuple(by.where(F.col("l_returnflag") == f).drop("l_returnflag").withColumn("src", F.lit(f)) for f in "RA")


TWO = """by_src as (select l_orderkey, l_returnflag as src, count(*) as n, max(l_partkey) as part from lineitem group by 1, 2),
    pref as (select * from by_src where src = 'R'), fall as (select * from by_src where src = 'A')"""


@query("B15_resolve_source", f"with {TWO} select l_orderkey, n, part, src from pref union all select l_orderkey, n, part, src from fall where l_orderkey not in (select l_orderkey from pref)")
def b15(t: Tables) -> DataFrame:
    return R.resolve_source(*_two(t), ["l_orderkey"]).select("l_orderkey", "n", "part", "src")


@query("B15_coalesce_source", f"with {TWO} select coalesce(p.l_orderkey, f.l_orderkey) as l_orderkey, coalesce(p.part, f.part) as part from pref p full join fall f on p.l_orderkey = f.l_orderkey")
def b15b(t: Tables) -> DataFrame:
    return R.coalesce_source(*_two(t), ["l_orderkey"], ["part"])


@query("C1_inner_join", "select l.l_orderkey, l.l_linenumber, o.o_orderdate, l.l_extendedprice from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderstatus = 'F'")
def c1(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").join(o, "l_orderkey")


@query("C2_left_join_multi_key", """
    with field as (select race_id, runner, count(*) as n from starts group by 1, 2)
    select s.race_id, s.runner, s.horse_id, f.n, c.c_name from starts s left join field f on s.race_id = f.race_id and s.runner = f.runner
    left join customer c on c.c_custkey = s.trainer_id""")  # fmt: skip
def c2(t: Tables) -> DataFrame:
    field = t.starts.groupBy("race_id", "runner").agg(F.count(F.lit(1)).alias("n"))
    names = t.customer.select(F.col("c_custkey").alias("trainer_id"), "c_name")
    return t.starts.join(field, ["race_id", "runner"], "left").join(names, "trainer_id", "left").select("race_id", "runner", "horse_id", "n", "c_name")


@query("C3_null_safe_join", """
    with a as (select surface, nullif(going_wetness, 4) as wet, count(*) as n from starts group by 1, 2),
         b as (select surface, nullif(going_wetness, 4) as wet, avg(win_odds) as odds from starts group by 1, 2)
    select a.surface, a.wet, n, odds from a join b on a.surface is not distinct from b.surface and a.wet is not distinct from b.wet""")  # fmt: skip
def c3(t: Tables) -> DataFrame:
    s = t.starts.withColumn("wet", F.nullif(F.col("going_wetness"), F.lit(4)))
    a = s.groupBy("surface", "wet").agg(F.count(F.lit(1)).alias("n"))
    b = s.groupBy("surface", "wet").agg(F.avg("win_odds").alias("odds"))
    return R.null_safe_join(a, b, ["surface", "wet"])


@query("C4_optional_key_join", """
    with r as (select race_id, horse_id, case when race_id % 3 = 0 then null else runner end as runner, finish_position from starts where finish_position <= 2)
    select s.race_id, s.runner, s.horse_id, r.finish_position as placed from starts s left join r
    on s.race_id = r.race_id and s.horse_id = r.horse_id and (r.runner is null or r.runner = s.runner)""")  # fmt: skip
def c4(t: Tables) -> DataFrame:
    r = t.starts.where("finish_position <= 2").select(
        "race_id", "horse_id", F.when(F.col("race_id") % 3 != 0, F.col("runner")).alias("runner"), F.col("finish_position").alias("placed")
    )
    return R.optional_key_join(t.starts.select("race_id", "runner", "horse_id"), r, ["race_id", "horse_id"], "runner")


@query("C5_prior_history", f"""
    with h as (select jockey_id, race_date, available_at, count(*) as starts_, {WIN} as wins from starts where jockey_id <> 0 group by 1, 2, 3),
         q as (select distinct jockey_id, race_date, race_date + interval '20 days' as as_of from starts),
         f as (select q.jockey_id, q.race_date, q.as_of, sum(starts_) as prior_starts, sum(wins) as prior_wins
               from q join h on h.jockey_id = q.jockey_id and h.race_date < q.race_date and h.available_at <= q.as_of
               and h.race_date >= q.race_date - interval '365 days' group by 1, 2, 3)
    select s.race_id, s.runner, s.jockey_id, cast(coalesce(prior_starts, 0) as bigint) as prior_starts, cast(coalesce(prior_wins, 0) as bigint) as prior_wins
    from starts s left join f on s.jockey_id = f.jockey_id and s.race_date = f.race_date""")  # fmt: skip
def c5(t: Tables) -> DataFrame:
    s = t.starts.select("race_id", "runner", "jockey_id", "race_date", (F.col("race_date") + F.expr("interval 20 days")).alias("as_of"))
    sums = {"prior_starts": F.lit(1), "prior_wins": (F.col("finish_position") == 1).cast("int")}
    out = R.prior_history(s, t.starts, "jockey_id", "race_date", "available_at", "as_of", sums, days=365, guard=F.col("jockey_id") != 0)
    return out.select("race_id", "runner", "jockey_id", "prior_starts", "prior_wins")


@query("C7_bounded_lookback", """
    with q as (select horse_id, race_id, race_date from starts)
    select q.race_id, q.horse_id, count(h.available_at) as works, max(h.available_at) as last_work, min(h.finish_time_seconds) as best
    from q left join starts h on h.horse_id = q.horse_id and h.available_at <= q.race_date and h.available_at >= q.race_date - interval '30 days'
    group by 1, 2""")  # fmt: skip
def c7(t: Tables) -> DataFrame:
    h = t.starts.select(F.col("horse_id").alias("h"), F.col("available_at").alias("a"), "finish_time_seconds")
    on = (F.col("h") == F.col("horse_id")) & (F.col("a") <= F.col("race_date")) & (F.col("a") >= F.col("race_date") - F.expr("interval 30 days"))
    q = t.starts.select("horse_id", "race_id", "race_date")
    return q.join(h, on, "left").groupBy("race_id", "horse_id").agg(F.count("a").alias("works"), F.max("a").alias("last_work"), F.min("finish_time_seconds").alias("best"))


@query("C10_semi_join", "select race_id, runner, win_odds from starts where race_id in (select o_orderkey from orders where o_totalprice > 200000)")
def c10(t: Tables) -> DataFrame:
    keys = t.orders.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("race_id"))
    return t.once("starts").join(keys, "race_id", "left_semi").select("race_id", "runner", "win_odds")


@query("C11_anti_join", "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def c11(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("C12_visibility", """
    select distinct ticket_id, user_id from tickets t where exists (select 1 from edges e where e.source_id = t.user_id and e.state = 'accepted')
    and not exists (select 1 from edges b where b.source_id = t.user_id and b.target_id = 7 and b.state = 'pending') and t.state not in ('open')""")  # fmt: skip
def c12(t: Tables) -> DataFrame:
    allowed = t.edges.where("state = 'accepted'").select(F.col("source_id").alias("user_id")).distinct()
    blocked = t.edges.where("state = 'pending' and target_id = 7").select(F.col("source_id").alias("user_id"))
    return t.tickets.where("state <> 'open'").join(allowed, "user_id", "left_semi").join(blocked, "user_id", "left_anti").select("ticket_id", "user_id").distinct()


@query("C13_two_hop_join", f"""
    with parent as (select p_partkey as horse_id, p_brand as sire from part),
         hist as (select pa.sire, s.horse_id, count(*) as n, {WIN} as wins from starts s join parent pa on pa.horse_id = s.horse_id group by 1, 2),
         tot as (select sire, sum(n) as n, sum(wins) as wins from hist group by 1)
    select h.horse_id, cast(t.n - h.n as bigint) as sibling_starts, cast(t.wins - h.wins as bigint) as sibling_wins from hist h join tot t on h.sire = t.sire""")  # fmt: skip
def c13(t: Tables) -> DataFrame:
    parent = t.part.select(F.col("p_partkey").alias("horse_id"), F.col("p_brand").alias("sire"))
    hist = t.starts.join(parent, "horse_id").groupBy("sire", "horse_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("finish_position") == 1).alias("w"))
    tot = hist.groupBy("sire").agg(F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    # All siblings less the runner itself: a difference of sums instead of pairs of siblings.
    return hist.join(tot, "sire").select("horse_id", (F.col("tn") - F.col("n")).alias("sibling_starts"), (F.col("tw") - F.col("w")).alias("sibling_wins"))


@query("C14_prior_year_bucket", """
    with b as (select distinct surface, going_wetness, year(race_date) as y from starts)
    select b.surface, b.going_wetness, b.y, median(s.finish_time_seconds) as par, count(*) as n from b join starts s
    on b.surface is not distinct from s.surface and b.going_wetness is not distinct from s.going_wetness and year(s.race_date) < b.y group by 1, 2, 3""")  # fmt: skip
def c14(t: Tables) -> DataFrame:
    s = t.starts.select("surface", "going_wetness", F.year("race_date").alias("y"), "finish_time_seconds")
    return R.growing_median(s, ["surface", "going_wetness"], "y", "finish_time_seconds").withColumnRenamed("median", "par")


@query("D1_field_size", "select race_id, count(*) as field_size from starts group by 1")
def d1(t: Tables) -> DataFrame:
    return t.starts.groupBy("race_id").agg(F.count(F.lit(1)).alias("field_size"))


@query("D2_conditional_aggregates", f"""
    select horse_id, count(*) as n, {WIN} as wins, avg(case when going_wetness >= 3 then finish_position end) as wet_avg,
           max(case when surface = 'F' then win_odds end) as max_f from starts group by 1""")  # fmt: skip
def d2(t: Tables) -> DataFrame:
    return t.starts.groupBy("horse_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("finish_position") == 1, 1).otherwise(0)).alias("wins"),
        F.avg(F.when(F.col("going_wetness") >= 3, F.col("finish_position"))).alias("wet_avg"), F.max(F.when(F.col("surface") == "F", F.col("win_odds"))).alias("max_f"),
    )


@query("D3_median", "select racecourse, surface, median(finish_time_seconds) as median_time from starts group by 1, 2")
def d3(t: Tables) -> DataFrame:
    return t.starts.groupBy("racecourse", "surface").agg(F.median("finish_time_seconds").alias("median_time"))


@query("D4_mad_z", """
    with m as (select pool, median(win_odds) as med from odds_ts group by 1),
         d as (select o.*, med, abs(win_odds - med) as off from odds_ts o join m on o.pool = m.pool),
         s as (select pool, median(off) as mad from d group by 1)
    select race_id, d.pool, runner, available_at, med, mad, case when mad <> 0 then (win_odds - med) / (1.4826 * mad) end as robust_z from d join s on d.pool = s.pool""")  # fmt: skip
def d4(t: Tables) -> DataFrame:
    return R.mad_z(t.odds_ts, ["pool"], "win_odds").select("race_id", "pool", "runner", "available_at", "med", "mad", "robust_z")


@query("D5_volatility", "select race_id, runner, round(stddev_samp(ln(win_odds)), 9) as odds_volatility from odds_ts group by 1, 2")
def d5(t: Tables) -> DataFrame:
    return t.odds_ts.groupBy("race_id", "runner").agg(F.round(F.stddev_samp(F.ln("win_odds")), 9).alias("odds_volatility"))


@query("D6_pivot_by_rank", """
    select race_id, runner, max(case when rn = 1 then win_odds end) as last_odds, max(case when rn = 2 then win_odds end) as second_odds,
           max(case when rn = 3 then win_odds end) as third_odds, max(case when ra = 1 then win_odds end) as open_odds
    from (select *, row_number() over (partition by race_id, runner order by available_at desc) as rn,
          row_number() over (partition by race_id, runner order by available_at) as ra from odds_ts) group by 1, 2""")  # fmt: skip
def d6(t: Tables) -> DataFrame:
    w = Window.partitionBy("race_id", "runner")
    ranked = t.odds_ts.withColumn("rn", F.row_number().over(w.orderBy(F.desc("available_at"))))
    pick = lambda k: F.max(F.when(F.col("rn") == k, F.col("win_odds")))
    return ranked.groupBy("race_id", "runner").agg(pick(1).alias("last_odds"), pick(2).alias("second_odds"), pick(3).alias("third_odds"), F.min_by("win_odds", "available_at").alias("open_odds"))


@query("D7_ordered_lists", """
    select race_id, array_to_string(list(horse_id order by finish_position), ',') as finish_order,
           array_to_string(list(runner order by runner) filter (where win_odds < 20), ',') as short_runners from starts group by 1""")  # fmt: skip
def d7(t: Tables) -> DataFrame:
    order = F.transform(F.array_sort(F.collect_list(F.struct("finish_position", "horse_id"))), lambda z: z["horse_id"])
    short = F.array_sort(F.collect_list(F.when(F.col("win_odds") < 20, F.col("runner"))))
    blank = lambda c: F.when(F.size(c) > 0, F.array_join(c.cast("array<string>"), ","))
    return t.starts.groupBy("race_id").agg(blank(order).alias("finish_order"), blank(short).alias("short_runners"))


@query("D8_count_distinct", "select surface, count(distinct race_id) as races, count(distinct race_date) as cards from starts group by 1")
def d8(t: Tables) -> DataFrame:
    return t.starts.groupBy("surface").agg(F.countDistinct("race_id").alias("races"), F.countDistinct("race_date").alias("cards"))


@query("D9_max_collapse", "select l_orderkey, l_linenumber, max(l_extendedprice) as payout from lineitem group by 1, 2")
def d9(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("payout"))


STATS = f"count(*) as starts, {WIN} as wins, {TOP3} as top3, round({WIN} * 1.0::double / count(*), 3) as win_pct, round({TOP3} * 1.0::double / count(*), 3) as top3_pct"


@query("D10_split_stats", f"select horse_id, surface, {STATS} from starts where horse_id is not null and surface is not null group by 1, 2")
def d10(t: Tables) -> DataFrame:
    return R.split_stats(t.starts, ["horse_id", "surface"], "finish_position")


@query("D11_style_profile", """
    select horse_id, surface as style, count(*) as n from (select *, row_number() over (partition by horse_id order by race_date desc, race_id, runner) as rn from starts)
    where rn <= 10 group by 1, 2""")  # fmt: skip
def d11(t: Tables) -> DataFrame:
    recent = R.top_k(t.starts, ["horse_id"], [F.desc("race_date"), "race_id", "runner"], 10)
    return recent.groupBy("horse_id", F.col("surface").alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("D12_binomial_z", f"""
    select 'jockey' as role, jockey_id as id, count(*) as n, {WIN} as hits, round({WIN} * 1.0::double / count(*), 9) as rate,
           round(({WIN} * 1.0::double / count(*) - 0.2) / sqrt(0.16::double / count(*)), 6) as z from starts group by 2 having count(*) >= 30
    union all select 'trainer', trainer_id, count(*), {WIN}, round({WIN} * 1.0::double / count(*), 9),
           round(({WIN} * 1.0::double / count(*) - 0.2) / sqrt(0.16::double / count(*)), 6) from starts group by 2 having count(*) >= 30""")  # fmt: skip
def d12(t: Tables) -> DataFrame:
    out = []
    for role in ("jockey", "trainer"):
        z = R.binomial_z(t.starts, [f"{role}_id"], F.col("finish_position") == 1, 0.2, 30)
        out.append(z.select(F.lit(role).alias("role"), F.col(f"{role}_id").alias("id"), "n", "hits", F.round("rate", 9).alias("rate"), F.round("z", 6).alias("z")))
    return out[0].unionByName(out[1], allowMissingColumns=True)


@query("D13_summarize_by_tags", f"""
    select coalesce(case when win_odds < 10 then 'short' when win_odds < 30 then 'mid' end, 'neutral') as tag, surface, count(*) as n, {WIN} as wins,
           round(sum(1.0::double / win_odds), 6) as expected, round({WIN} * 1.0::double / count(*), 9) as win_rate,
           round(sum(case when finish_position = 1 then win_odds else 0 end) / count(*) - 1, 9) as roi from starts group by 1, 2""")  # fmt: skip
def d13(t: Tables) -> DataFrame:
    tag = F.when(F.col("win_odds") < 10, "short").when(F.col("win_odds") < 30, "mid")
    n, wins = F.count(F.lit(1)), F.count_if(F.col("finish_position") == 1)
    return t.once("starts").groupBy(F.coalesce(tag, F.lit("neutral")).alias("tag"), "surface").agg(
        n.alias("n"), wins.alias("wins"), F.round(F.sum(1.0 / F.col("win_odds")), 6).alias("expected"), F.round(wins / n, 9).alias("win_rate"),
        F.round(F.sum(F.when(F.col("finish_position") == 1, F.col("win_odds")).otherwise(0.0)) / n - 1, 9).alias("roi"),
    )


@query("D14_punter_stats", """
    select user_id, count(*) filter (where state = 'won') as won, count(*) filter (where state = 'open') as open, sum(cost) as wagered,
           sum(case when state = 'refunded' then cost else coalesce(returned, 0) end) as returned,
           sum(case when state = 'refunded' then cost else coalesce(returned, 0) end) - sum(cost) as net,
           round((sum(case when state = 'refunded' then cost else coalesce(returned, 0) end) - sum(cost)) * 1.0::double / sum(cost), 9) as roi,
           arg_max(ticket_id, (coalesce(returned, 0), -ticket_id)) as biggest from tickets where state <> 'open' or cost > 0 group by 1""")  # fmt: skip
def d14(t: Tables) -> DataFrame:
    back = F.sum(F.when(F.col("state") == "refunded", F.col("cost")).otherwise(F.coalesce("returned", F.lit(0))))
    cost = F.sum("cost")
    return t.tickets.where("state <> 'open' or cost > 0").groupBy("user_id").agg(
        F.count_if(F.col("state") == "won").alias("won"), F.count_if(F.col("state") == "open").alias("open"), cost.alias("wagered"), back.alias("returned"),
        (back - cost).alias("net"), F.round((back - cost) / cost, 9).alias("roi"),
        F.max_by("ticket_id", F.struct(F.coalesce("returned", F.lit(0)), -F.col("ticket_id"))).alias("biggest"),
    )


@query("D15_live_counts", "select user_id, count(*) filter (where event_type <> 'error') as live, count(*) filter (where event_type = 'view') as unread from events group by 1")
def d15(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("live"), F.count_if(F.col("event_type") == "view").alias("unread"))


@query("D16_completeness_guard", """
    with c as (select race_date, racecourse, count(*) as n from starts group by 1, 2), p as (select race_date, racecourse, n + (n % 3) - 1 as prior_n from c where n % 5 <> 0)
    select c.race_date, c.racecourse, n, greatest(coalesce(prior_n, 0), 0) as mark, n >= greatest(coalesce(prior_n, 0), 0) and n >= 6 as publish,
           greatest(n, coalesce(prior_n, 0)) as new_mark from c left join p on c.race_date = p.race_date and c.racecourse = p.racecourse""")  # fmt: skip
def d16(t: Tables) -> DataFrame:
    c = t.starts.groupBy("race_date", "racecourse").agg(F.count(F.lit(1)).alias("n"))
    p = c.where("n % 5 <> 0").select("race_date", "racecourse", (F.col("n") + F.col("n") % 3 - 1).alias("prior_n"))
    return R.completeness_guard(c, p, ["race_date", "racecourse"])


@query("D17_reconcile", f"with {TWO} select count(*) as overlap, count(*) filter (where p.n <> f.n) as mismatches, count(*) filter (where p.n <> f.n) * 1.0::double / count(*) as mismatch_rate from pref p join fall f on p.l_orderkey = f.l_orderkey")
def d17(t: Tables) -> DataFrame:
    return R.reconcile(*_two(t), ["l_orderkey"], "n")


@query("F1_recent_per_entity", """
    select horse_id, race_id, race_date, rn from (select *, row_number() over (partition by horse_id order by race_date desc, race_id, runner) as rn from starts) where rn <= 8""")  # fmt: skip
def f1(t: Tables) -> DataFrame:
    return R.top_k(t.starts, ["horse_id"], [F.desc("race_date"), "race_id", "runner"], 8, "rn").select("horse_id", "race_id", "race_date", "rn")


@query("F2_top_combos", f"""
    select jockey_id, horse_id, n, wins from (select *, row_number() over (partition by jockey_id order by n desc, horse_id) as rn
      from (select jockey_id, horse_id, count(*) as n, {WIN} as wins from starts group by 1, 2)) where rn <= 5""")  # fmt: skip
def f2(t: Tables) -> DataFrame:
    c = t.starts.groupBy("jockey_id", "horse_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("finish_position") == 1).alias("wins"))
    return R.top_k(c, ["jockey_id"], [F.desc("n"), "horse_id"], 5)


@query("F3_top_pick", "select race_id, runner, win_odds from (select *, row_number() over (partition by race_id order by win_odds, runner) as rn from starts) where rn = 1")
def f3(t: Tables) -> DataFrame:
    return R.top_k(t.starts, ["race_id"], ["win_odds", "runner"], 1).select("race_id", "runner", "win_odds")


@query("F4_newest_rows", "select ticket_id, user_id, created_at from tickets order by created_at desc, ticket_id desc limit 100")
def f4(t: Tables) -> DataFrame:
    return t.tickets.orderBy(F.desc("created_at"), F.desc("ticket_id")).limit(100).select("ticket_id", "user_id", "created_at")


@query("F5_remove_top", """
    select surface, count(*) as n, round(sum(win_odds), 6) as total from (select *, row_number() over (partition by surface order by win_odds desc, race_id, runner) as rn from starts where finish_position = 1)
    where rn > 10 group by 1""")  # fmt: skip
def f5(t: Tables) -> DataFrame:
    left = R.remove_top(t.starts.where("finish_position = 1"), ["surface"], "win_odds", 10, ["race_id", "runner"])
    return left.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("win_odds"), 6).alias("total"))


@query("F6_union_all", "select race_id, runner, win_odds from starts where surface = 'F' union all select race_id, runner, win_odds from starts where finish_position = 1")
def f6(t: Tables) -> DataFrame:
    s = t.starts.select("race_id", "runner", "win_odds", "surface", "finish_position")
    return s.where("surface = 'F'").unionAll(s.where("finish_position = 1")).select("race_id", "runner", "win_odds")


@query("F7_union_by_name", "select jockey_id, n, cast(null as bigint) as trainer_id from (select jockey_id, count(*) as n from starts group by 1) union all select null, n, trainer_id from (select trainer_id, count(*) as n from starts group by 1)")
def f7(t: Tables) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    return t.starts.groupBy("jockey_id").agg(n).unionByName(t.starts.groupBy("trainer_id").agg(n), allowMissingColumns=True)


@query("F8_intersect", "select source_id, target_id from edges where state = 'accepted' intersect select target_id, source_id from edges where state = 'accepted'")
def f8(t: Tables) -> DataFrame:
    e = t.edges.where("state = 'accepted'").select("source_id", "target_id")
    return e.intersect(e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))


@query("F9_except", "select l_orderkey from lineitem where l_returnflag = 'R' except select l_orderkey from lineitem where l_returnflag = 'A'")
def f9(t: Tables) -> DataFrame:
    k = t.lineitem.select("l_orderkey", "l_returnflag")
    return k.where("l_returnflag = 'R'").select("l_orderkey").subtract(k.where("l_returnflag = 'A'").select("l_orderkey"))


@query("F10_distinct", "select distinct race_id, jockey_id from starts")
def f10(t: Tables) -> DataFrame:
    return t.starts.select("race_id", "jockey_id").distinct()
