"""Queries over sections: windows (E), point-in-time joins (C6, C8, C9), ordering (J) and settlement (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import ordering as O
from ..operators import relational as R
from ..operators import settlement as S
from .bindings import Tables
from .registry import query

DEVIG = "(1.0 / win_odds) / sum(1.0 / win_odds) over (partition by race_id)"
P = f"pr as (select race_id, runner, finish_position, {DEVIG} as p from starts)"


@query("C6_asof_devig", """
    with q as (select race_id, runner, minutes, max(post_time) - minutes * interval '1 minute' as as_of from odds_ts cross join (select unnest([60, 360, 720]) as minutes) group by 1, 2, 3),
    j as (select q.race_id, q.runner, q.minutes, q.as_of, o.available_at, o.win_odds, row_number() over (partition by q.race_id, q.runner, q.minutes order by o.available_at desc nulls last) as rn
          from q left join odds_ts o on o.race_id = q.race_id and o.runner = q.runner and o.available_at <= q.as_of)
    select race_id, runner, minutes, available_at, win_odds, (1.0 / win_odds) / sum(1.0 / win_odds) over (partition by race_id, minutes) as devigged_prob_at_t from j where rn = 1""")  # fmt: skip
def c6(t: Tables) -> DataFrame:
    grid = t.odds_ts.groupBy("race_id", "runner").agg(F.max("post_time").alias("post")).withColumn("minutes", F.explode(F.array(*map(F.lit, (60, 360, 720)))))
    grid = grid.withColumn("as_of", F.col("post") - F.make_dt_interval(mins=F.col("minutes")))
    hit = R.asof_join(grid, t.odds_ts, ["race_id", "runner"], "as_of", "available_at", ["win_odds"])
    return M.devig(hit, ["race_id", "minutes"], "win_odds", "devigged_prob_at_t").select("race_id", "runner", "minutes", "available_at", "win_odds", "devigged_prob_at_t")


@query("C8_nearest_in_time", """
    with q as (select race_id, runner, max(post_time) - interval '6 hours' as target from odds_ts group by 1, 2),
    j as (select q.race_id, q.runner, o.available_at, o.win_odds, row_number() over (partition by q.race_id, q.runner order by abs(epoch(q.target) - epoch(o.available_at))) as rn
          from q join odds_ts o on o.race_id = q.race_id and o.runner = q.runner and o.available_at <= q.target and o.available_at >= q.target - interval '12 hours')
    select race_id, runner, available_at, win_odds from j where rn = 1""")  # fmt: skip
def c8(t: Tables) -> DataFrame:
    q = t.odds_ts.groupBy("race_id", "runner").agg((F.max("post_time") - F.expr("interval 6 hours")).alias("target"))
    hit = R.nearest_in_time(q, t.odds_ts, ["race_id", "runner"], "target", "available_at", ["win_odds"], "12 hours")
    return hit.where("available_at is not null").select("race_id", "runner", "available_at", "win_odds")


@query("C9_decision_grid", "select race_id, runner, minutes from (select distinct race_id, runner from odds_ts) cross join (select unnest([5, 10, 30, 60]) as minutes)")
def c9(t: Tables) -> DataFrame:
    return t.odds_ts.select("race_id", "runner").distinct().withColumn("minutes", F.explode(F.array(*map(F.lit, (5, 10, 30, 60)))))


@query("E1_devig", f"select race_id, runner, {DEVIG} as p from starts")
def e1(t: Tables) -> DataFrame:
    return M.devig(t.starts, ["race_id"], "win_odds").select("race_id", "runner", "p")


@query("E2_overround_entropy", """
    with b as (select *, 1.0 / win_odds as raw, sum(1.0 / win_odds) over (partition by race_id, available_at) as overround from odds_ts)
    select race_id, runner, available_at, round(overround, 9) as overround, round(raw / overround, 9) as devigged_prob,
      round(0.0 - sum(raw / overround * ln(greatest(raw / overround, 1e-12))) over (partition by race_id, available_at), 8) as market_entropy,
      rank() over (partition by race_id, available_at order by win_odds, runner) as odds_rank from b""")  # fmt: skip
def e2(t: Tables) -> DataFrame:
    m = M.snapshot_market(t.odds_ts, ["race_id", "available_at"], "win_odds", "runner")
    return m.select("race_id", "runner", "available_at", F.round("overround", 9).alias("overround"), F.round("devigged_prob", 9).alias("devigged_prob"), F.round("market_entropy", 8).alias("market_entropy"), "odds_rank")


@query("E3_rank_nulls_last", "select race_id, runner, rank() over (partition by race_id order by case when runner = 1 then null else finish_time_seconds end asc nulls last) as speed_rank from starts")
def e3(t: Tables) -> DataFrame:
    x = F.when(F.col("runner") != 1, F.col("finish_time_seconds")).asc_nulls_last()
    return t.starts.select("race_id", "runner", F.rank().over(Window.partitionBy("race_id").orderBy(x)).alias("speed_rank"))


@query("E4_first_last_snapshot", """
    select race_id, runner, available_at, win_odds, first_seen, last_seen from (select *, row_number() over (partition by race_id, runner order by available_at) = 1 as first_seen,
      row_number() over (partition by race_id, runner order by available_at desc) = 1 as last_seen from odds_ts) where first_seen or last_seen""")  # fmt: skip
def e4(t: Tables) -> DataFrame:
    w = Window.partitionBy("race_id", "runner")
    x = t.odds_ts.withColumn("first_seen", F.row_number().over(w.orderBy("available_at")) == 1).withColumn("last_seen", F.row_number().over(w.orderBy(F.desc("available_at"))) == 1)
    return x.where("first_seen or last_seen").select("race_id", "runner", "available_at", "win_odds", "first_seen", "last_seen")


@query("E5_group_z", """
    select race_id, runner, round(case when stddev_samp(finish_time_seconds) over w > 0 then (finish_time_seconds - avg(finish_time_seconds) over w) / stddev_samp(finish_time_seconds) over w else 0 end, 8) as z
    from starts window w as (partition by race_id)""")  # fmt: skip
def e5(t: Tables) -> DataFrame:
    return t.starts.select("race_id", "runner", F.round(M.group_z("finish_time_seconds", ["race_id"]), 8).alias("z"))


@query("E6_finish_percentile", "select race_id, runner, case when count(finish_position) over w <= 1 then 1.0::double else 1.0::double - (finish_position - 1) / (count(finish_position) over w - 1) end as pct from starts window w as (partition by race_id)")
def e6(t: Tables) -> DataFrame:
    return t.starts.select("race_id", "runner", M.finish_percentile("finish_position", ["race_id"]).alias("pct"))


@query("E7_normalised_rank", "select race_id, runner, case when count(*) over (partition by race_id) <= 1 then 1.0::double else 1.0::double - (row_number() over (partition by race_id order by win_odds, runner) - 1) / (count(*) over (partition by race_id) - 1) end as r from starts")
def e7(t: Tables) -> DataFrame:
    return t.starts.select("race_id", "runner", M.normalised_rank(["win_odds", "runner"], ["race_id"]).alias("r"))


@query("E8_softmax", "select race_id, runner, round(exp(finish_time_seconds - max(finish_time_seconds) over w) / sum(exp(finish_time_seconds - m)) over w, 9) as p from (select *, max(finish_time_seconds) over (partition by race_id) as m from starts) window w as (partition by race_id)")
def e8(t: Tables) -> DataFrame:
    # The maximum is a column of its own, for a window can't be nested in a window.
    s = t.starts.withColumn("shifted", F.exp(F.col("finish_time_seconds") - F.max("finish_time_seconds").over(Window.partitionBy("race_id"))))
    return s.select("race_id", "runner", F.round(F.col("shifted") / F.sum("shifted").over(Window.partitionBy("race_id")), 9).alias("p"))


@query("E9_prior_window", "select horse_id, race_id, runner, sum(finish_position) over (partition by horse_id order by race_date, race_id, runner rows between 5 preceding and 1 preceding) as s from starts")
def e9(t: Tables) -> DataFrame:
    return t.starts.select("horse_id", "race_id", "runner", M.prior_sum("finish_position", ["horse_id"], ["race_date", "race_id", "runner"], 5).alias("s"))


@query("E10_first_sighting", "select race_id, runner, available_at, first_value(win_odds) over (partition by race_id, runner order by available_at) as opening from odds_ts")
def e10(t: Tables) -> DataFrame:
    return t.odds_ts.select("race_id", "runner", "available_at", M.carry_first("win_odds", ["race_id", "runner"], ["available_at"]).alias("opening"))


@query("E11_card_baseline", """
    select race_date, race_id, runner, first_value(case when going_wetness <> 1 then going_wetness end ignore nulls) over (partition by race_date order by race_id, runner rows between unbounded preceding and current row) as base_wetness from starts""")  # fmt: skip
def e11(t: Tables) -> DataFrame:
    s = t.once("starts").withColumn("wet", F.when(F.col("going_wetness") != 1, F.col("going_wetness")))
    return s.select("race_date", "race_id", "runner", M.carry_first("wet", ["race_date"], ["race_id", "runner"]).alias("base_wetness"))


OC = "oc as (select race_id, runner, arg_min(win_odds, available_at) as open_odds, arg_max(win_odds, available_at) as close_odds from odds_ts group by 1, 2)"


@query("E12_residual_drift", f"""
    with {OC}, d as (select *, ln(close_odds / open_odds) as d from oc), m as (select race_id, median(d) as med, count(d) as n, stddev_pop(d) as sd from d group by 1),
    x as (select d.*, med, n, sd, d.d - med as resid from d join m on d.race_id = m.race_id), a as (select race_id, median(abs(resid)) * 1.4826 as mad from x group by 1),
    z as (select x.*, exp(resid) - 1 as resid_pct, resid / (case when mad > 1e-6 then mad when sd > 0 then sd else 1e-6 end) as drift_z from x join a on x.race_id = a.race_id)
    select race_id, runner, round(resid_pct, 8) as resid_pct, round(drift_z, 7) as drift_z,
      case when n >= 6 and abs(resid_pct) >= 0.08 and abs(drift_z) >= 1.5 then case when resid_pct < 0 then 'firming' else 'draining' end end as direction from z""")  # fmt: skip
def e12(t: Tables) -> DataFrame:
    oc = t.odds_ts.groupBy("race_id", "runner").agg(F.min_by("win_odds", "available_at").alias("open_odds"), F.max_by("win_odds", "available_at").alias("close_odds"))
    return M.residual_drift(oc, ["race_id"], "close_odds", "open_odds").select("race_id", "runner", F.round("resid_pct", 8).alias("resid_pct"), F.round("drift_z", 7).alias("drift_z"), "direction")


@query("H4_power_calibrate", f"with {P} select race_id, runner, round(pow(greatest(p, 1e-12), 1.15) / sum(pow(greatest(p, 1e-12), 1.15)) over (partition by race_id), 9) as calibrated from pr")
def h4(t: Tables) -> DataFrame:
    return M.devig(t.starts, ["race_id"], "win_odds").select("race_id", "runner", F.round(M.power_calibrate("p", 1.15, ["race_id"]), 9).alias("calibrated"))


@query("H5_curve_features", """
    with tg as (select race_id, runner, minutes, max(post_time) - minutes * interval '1 minute' as as_of from odds_ts cross join (select unnest([60, 600]) as minutes) group by 1, 2, 3),
    b as (select *, 1.0 / win_odds as raw, sum(1.0 / win_odds) over (partition by race_id, available_at) as ov, rank() over (partition by race_id, available_at order by win_odds, runner) as rk from odds_ts),
    s as (select *, raw / ov as dp, 0.0 - sum(raw / ov * ln(greatest(raw / ov, 1e-12))) over (partition by race_id, available_at) as ent from b),
    j as (select tg.*, s.available_at, s.win_odds, s.dp, s.ent, s.rk, ln(s.win_odds) as lo, epoch(s.available_at) as ep,
          row_number() over (partition by tg.race_id, tg.runner, tg.minutes order by s.available_at asc nulls last) as ra,
          row_number() over (partition by tg.race_id, tg.runner, tg.minutes order by s.available_at desc nulls last) as rd
          from tg left join s on s.race_id = tg.race_id and s.runner = tg.runner and s.available_at <= tg.as_of),
    p as (select race_id, runner, minutes, as_of, max(case when ra = 1 then win_odds end) as open_win_odds, max(case when ra = 1 then rk end) as open_odds_rank, max(case when rd = 1 then win_odds end) as win_odds_at_t,
          max(case when rd = 1 then dp end) as devigged_prob_at_t, max(case when rd = 1 then rk end) as odds_rank_at_t, max(case when rd = 1 then ent end) as market_entropy_at_t, max(available_at) as max_source_available_at,
          max(case when rd = 1 then lo end) as l1, max(case when rd = 1 then ep end) as e1, max(case when rd = 2 then lo end) as l2, max(case when rd = 2 then ep end) as e2,
          max(case when rd = 3 then lo end) as l3, max(case when rd = 3 then ep end) as e3, stddev_samp(lo) as vol, count(win_odds) as n from j group by 1, 2, 3, 4)
    select race_id, runner, minutes, as_of, max_source_available_at, open_win_odds, win_odds_at_t, round(devigged_prob_at_t, 9) as devigged_prob_at_t, round(ln(win_odds_at_t / open_win_odds), 8) as drift_open_to_t,
      round(case when e1 > e2 then (l1 - l2) / ((e1 - e2) / 60.0) end, 8) as recent_velocity, round(case when e1 > e2 and e2 > e3 then (l1 - l2) / ((e1 - e2) / 60.0) - (l2 - l3) / ((e2 - e3) / 60.0) end, 8) as recent_acceleration,
      round(vol, 8) as odds_volatility, round(market_entropy_at_t, 8) as market_entropy_at_t, open_odds_rank, odds_rank_at_t, open_odds_rank - odds_rank_at_t as odds_rank_change, n as odds_snapshots_used from p""")  # fmt: skip
def h5(t: Tables) -> DataFrame:
    targets = t.odds_ts.groupBy("race_id", "runner").agg(F.max("post_time").alias("post"))
    out = M.curve_features(t.odds_ts, targets, "race_id", "runner", "available_at", "win_odds", "post", [60, 600])
    digits = {"devigged_prob_at_t": 9, "drift_open_to_t": 8, "recent_velocity": 8, "recent_acceleration": 8, "odds_volatility": 8, "market_entropy_at_t": 8}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


SEQ3 = f"""{P}, st as (select race_id, runner, p, pow(p, 0.856) as g, sum(p) over w as s1, sum(pow(p, 0.856)) over w as sg from pr where p > 0 window w as (partition by race_id)),
    seq as (select a.race_id, a.runner as a, b.runner as b, c.runner as c, a.p / a.s1 * b.g / (a.sg - a.g) * c.g / (a.sg - a.g - b.g) as prob
            from st a join st b on a.race_id = b.race_id and a.runner <> b.runner join st c on a.race_id = c.race_id and c.runner <> a.runner and c.runner <> b.runner)"""


def _p(t: Tables) -> DataFrame:
    return M.devig(t.starts, ["race_id"], "win_odds").select("race_id", "runner", "finish_position", "p")


@query("J1_sequence_prob", f"with {SEQ3} select race_id, a, b, c, round(prob, 9) as prob from seq")
def j1(t: Tables) -> DataFrame:
    return O.sequences(_p(t), "race_id", "runner", "p", 3, O.GAMMA, raw_first=True).withColumn("prob", F.round("prob", 9))


@query("J1_harville_exacta", f"with {P} select a.race_id, a.runner as a, b.runner as b, round(a.p * b.p / (1 - a.p), 8) as prob from pr a join pr b on a.race_id = b.race_id and a.runner <> b.runner")
def j1b(t: Tables) -> DataFrame:
    return O.sequences(_p(t), "race_id", "runner", "p", 2, 1.0).withColumn("prob", F.round("prob", 8))


@query("J2_quinella", f"""with {P}, st as (select race_id, runner, p, pow(p, 0.856) as g, sum(pow(p, 0.856)) over (partition by race_id) as sg from pr)
    select a.race_id, least(a.runner, b.runner) as a, greatest(a.runner, b.runner) as b, round(sum(a.p * b.g / (a.sg - a.g)), 8) as prob from st a join st b on a.race_id = b.race_id and a.runner <> b.runner group by 1, 2, 3""")  # fmt: skip
def j2(t: Tables) -> DataFrame:
    return O.combos(_p(t), "race_id", "runner", "p", "quinella").withColumn("prob", F.round("prob", 8))


@query("J2_trio", f"with {SEQ3} select race_id, list_sort([a, b, c])[1] as a, list_sort([a, b, c])[2] as b, list_sort([a, b, c])[3] as c, round(sum(prob), 8) as prob from seq group by 1, 2, 3, 4")
def j2b(t: Tables) -> DataFrame:
    return O.combos(_p(t), "race_id", "runner", "p", "trio").withColumn("prob", F.round("prob", 8))


@query("J3_wide", f"""with {SEQ3}, w as (select race_id, least(a, b) as a, greatest(a, b) as b, prob from seq union all select race_id, least(a, c), greatest(a, c), prob from seq union all select race_id, least(b, c), greatest(b, c), prob from seq)
    select race_id, a, b, round(sum(prob), 8) as prob from w group by 1, 2, 3""")  # fmt: skip
def j3(t: Tables) -> DataFrame:
    return O.combos(_p(t), "race_id", "runner", "p", "wide").withColumn("prob", F.round("prob", 8))


@query("J4_brackets", f"with {P} select race_id, (runner + 1) // 2 as bracket, round(sum(p), 9) as prob from pr group by 1, 2")
def j4(t: Tables) -> DataFrame:
    gates = _p(t).select("race_id", "runner", F.floor((F.col("runner") + 1) / 2).alias("bracket"))
    return O.aggregate_brackets(_p(t), gates, "race_id", "runner", "p").withColumn("prob", F.round("prob", 9))


@query("J7_price_combos", f"""with {P}, r as (select race_id, runner, p, row_number() over (partition by race_id order by p desc, runner) as rk, greatest(2, ceil(count(*) over (partition by race_id) / 3.0)) as cut from pr where p > 0),
    q as (select a.race_id, a.runner as a, b.runner as b, a.p * b.p / (1 - a.p) as prob, (a.rk <= a.cut)::int + (b.rk <= b.cut)::int as f from r a join r b on a.race_id = b.race_id and a.runner <> b.runner)
    select race_id, a, b, round(prob, 8) as prob, round(1 / prob + 1e-9, 4) as fair_odds, round(0.75 / prob + 1e-9, 4) as est_payout, case f when 2 then 'chalk' when 0 then 'value' else 'blend' end as tag from q where prob > 0""")  # fmt: skip
def j7(t: Tables) -> DataFrame:
    c = O.price(O.combos(_p(t), "race_id", "runner", "p", "exacta", 1.0), "exacta")
    out = O.value_tag(c, _p(t), "race_id", "runner", "p", ["a", "b"])
    return out.withColumns({"prob": F.round("prob", 8), "fair_odds": F.round(F.col("fair_odds") + 1e-9, 4), "est_payout": F.round(F.col("est_payout") + 1e-9, 4)})


@query("J8_bracket_pairs", f"""with {P}, q as (select a.race_id, a.runner as a, b.runner as b, a.p * b.p / (1 - a.p) + b.p * a.p / (1 - b.p) as prob from pr a join pr b on a.race_id = b.race_id and a.runner < b.runner)
    select race_id, least((a + 1) // 2, (b + 1) // 2) as lo, greatest((a + 1) // 2, (b + 1) // 2) as hi, round(sum(prob), 8) as prob, count(*) as points from q group by 1, 2, 3""")  # fmt: skip
def j8(t: Tables) -> DataFrame:
    gates = _p(t).select("race_id", F.col("runner").alias("item"), F.floor((F.col("runner") + 1) / 2).alias("bracket"))
    return O.bracket_pairs(O.combos(_p(t), "race_id", "runner", "p", "quinella", 1.0), gates, "race_id").withColumn("prob", F.round("prob", 8))


SETS = """sets as (select l_orderkey as ticket, 0 as place, l_linenumber as item from lineitem where l_returnflag <> 'N' group by 1, 3
    union all select l_orderkey, 1, l_linenumber from lineitem group by 1, 3 union all select l_orderkey, 2, l_linenumber from lineitem where l_linestatus = 'F' group by 1, 3)"""


def _sets(t: Tables) -> DataFrame:
    # One scan, dealt by ticket once.
    places = F.array_compact(F.array(F.when(F.col("l_returnflag") != "N", 0), F.lit(1), F.when(F.col("l_linestatus") == "F", 2)))
    rows = t.lineitem.select(F.col("l_orderkey").alias("ticket"), F.col("l_linenumber").alias("item"), places.alias("place"))
    return rows.repartition("ticket").select("ticket", F.explode("place").alias("place"), "item").distinct()


@query("J10_formation", f"with {SETS}, x as (select ticket, item from sets where place = 0), y as (select ticket, item from sets where place = 1), z as (select ticket, item from sets where place = 2) select x.ticket, x.item as a, y.item as b, z.item as c from x join y on x.ticket = y.ticket and x.item <> y.item join z on x.ticket = z.ticket and x.item <> z.item and y.item <> z.item")
def j10(t: Tables) -> DataFrame:
    return O.formation(_sets(t), "ticket", 3, ordered=True)


@query("J11_finalize_tickets", f"""with {P}, q as (select a.race_id, a.p * b.p / (1 - a.p) as prob from pr a join pr b on a.race_id = b.race_id and a.runner <> b.runner where a.runner <= 3 and b.runner <= 4),
    f as (select race_id, count(*) as n_lines, count(*) * 100.0::double as cost, least(0.98::double, sum(prob)) as hit_prob, sum(prob * 0.75 / prob * 100) as expected, avg(0.75 / prob * 100) as avg_payout, max(0.75 / prob * 100) as best_case from q group by 1)
    select race_id, n_lines, cost, round(hit_prob, 8) as hit_prob, round(expected, 5) as expected, round(avg_payout + 1e-9, 3) as avg_payout, round(best_case + 1e-9, 3) as best_case, case when round(hit_prob, 12) < 0.15 or round(avg_payout / 100, 9) > 30 then 'high' else 'low' end as variance from f""")  # fmt: skip
def j11(t: Tables) -> DataFrame:
    lines = O.price(O.combos(_p(t), "race_id", "runner", "p", "exacta", 1.0).where("a <= 3 and b <= 4"), "exacta")
    out = O.finalize_tickets(lines, "race_id", 100.0)
    return out.withColumns({"hit_prob": F.round("hit_prob", 8), "expected": F.round("expected", 5), "avg_payout": F.round(F.col("avg_payout") + 1e-9, 3), "best_case": F.round(F.col("best_case") + 1e-9, 3)})


@query("J11_finalize_all", f"""with {P}, q as (select a.race_id, a.p * b.p / (1 - a.p) as prob from pr a join pr b on a.race_id = b.race_id and a.runner <> b.runner where a.p > 0 and b.p > 0)
    select race_id, count(*) as n_lines, count(*) * 100.0::double as cost, round(least(0.98::double, sum(prob)), 8) as hit_prob, round(sum(prob * 0.75 / prob * 100), 5) as expected, round(max(0.75 / prob * 100) + 1e-9, 3) as best_case from q group by 1""")  # fmt: skip
def j11_all(t: Tables) -> DataFrame:
    lines = O.price(O.combos(_p(t), "race_id", "runner", "p", "exacta", 1.0), "exacta")
    out = O.finalize_tickets(lines, "race_id", 100.0)
    return out.select("race_id", "n_lines", "cost", F.round("hit_prob", 8).alias("hit_prob"), F.round("expected", 5).alias("expected"), F.round(F.col("best_case") + 1e-9, 3).alias("best_case"))


@query("J12_classify_structure", f"""with {SETS}, l as (select distinct x.ticket, least(x.item, y.item) as a, greatest(x.item, y.item) as b from sets x join sets y on x.ticket = y.ticket where x.place = 0 and y.place = 1 and x.item <> y.item),
    i as (select ticket, count(distinct item) as n from (select ticket, a as item from l union all select ticket, b from l) group by 1), c as (select ticket, count(*) as n_lines from l group by 1)
    select c.ticket, n, n_lines, case when n_lines = n * (n - 1) / 2 then 'box' else 'custom' end as structure from c join i on c.ticket = i.ticket""")  # fmt: skip
def j12(t: Tables) -> DataFrame:
    return O.classify_structure(O.formation(_sets(t), "ticket", 2, ordered=False), "ticket", 2, ordered=False)


LL = f"""{P}, sel as (select * from pr), g as (select unnest([0.6, 0.8, 1.0, 1.2])::double as gamma),
    a as (select race_id, gamma, sum(exp(gamma * ln(greatest(p, 1e-12)))) as s, max(case when finish_position = 1 then ln(greatest(p, 1e-12)) end) as l1, max(case when finish_position = 2 then ln(greatest(p, 1e-12)) end) as l2 from sel cross join g group by 1, 2),
    ll as (select race_id, gamma, gamma * l1 - ln(s) + coalesce(gamma * l2 - ln(greatest(s - exp(gamma * l1), 1e-300)), 0) as ll from a)"""


SHORT = (0.6, 0.8, 1.0, 1.2)


def _curves(t: Tables, grid=SHORT, places: int = 2, compact: bool = False) -> DataFrame:
    sel = _p(t)
    return O.gamma_likelihood(sel, sel.select("race_id", "runner", F.col("finish_position").alias("position")), "race_id", "runner", "p", grid, places=places, compact=compact)


@query("J6_gamma_global", f"with {LL}, t as (select gamma, sum(ll) as ll from ll group by 1) select gamma, round(ll, 5) as ll from t order by ll desc, gamma limit 1")
def j6(t: Tables) -> DataFrame:
    return O.fit_gamma_global(_curves(t)).withColumn("ll", F.round("ll", 5))


@query("J5_gamma_walkforward", f"""with {LL}, w as (select *, row_number() over (partition by gamma order by race_id) as n, sum(round(ll, 9)) over (partition by gamma order by race_id rows between 100 preceding and 1 preceding) as total from ll),
    r as (select *, row_number() over (partition by race_id order by total desc, gamma) as rk from w) select race_id, case when n > 100 then gamma else 1.0 end as gamma from r where rk = 1""")  # fmt: skip
def j5(t: Tables) -> DataFrame:
    return O.fit_gamma_walkforward(_curves(t, compact=True), ["race_id"], "race_id", window=100, grid=SHORT, places=2, digits=9)


@query("J6_gamma_global_whole")
def j6_whole(t: Tables) -> DataFrame:
    return O.fit_gamma_global(_curves(t, O.GAMMAS, 3)).withColumn("ll", F.round("ll", 5))


@query("J5_gamma_walkforward_whole")
def j5_whole(t: Tables) -> DataFrame:
    return O.fit_gamma_walkforward(_curves(t, O.GAMMAS, 3, compact=True), ["race_id"], "race_id", window=1000, grid=O.GAMMAS, digits=9)


BETS = "bets as (select race_id, 'win' as pool, lpad(cast(runner as varchar), 2, '0') as combo, 100 * (runner % 3 + 1) as stake from starts union all select race_id, 'win', '09', 300 from starts where runner = 1)"


def _bets(t: Tables) -> DataFrame:
    a = t.starts.select("race_id", F.lit("win").alias("pool"), F.lpad(F.col("runner").cast("string"), 2, "0").alias("combo"), (100 * (F.col("runner") % 3 + 1)).alias("stake"))
    return a.unionByName(t.starts.where("runner = 1").select("race_id", F.lit("win").alias("pool"), F.lit("09").alias("combo"), F.lit(300).alias("stake")))


@query("G1_settle_bets", f"""with {BETS}, o as (select race_id, pool, combo, max(payout_yen) as official from payouts group by 1, 2, 3),
    sc as (select race_id, lpad(cast(runner as varchar), 2, '0') as combo from starts where finish_position > 5)
    select b.race_id, b.pool, b.combo, b.stake, cast(coalesce(official * stake / 100, 0) as bigint) as payout, cast(case when official is null and sc.combo is not null then stake else 0 end as bigint) as refund,
      case when official is not null then 'official_payout' when sc.combo is not null then 'refund' else 'loss' end as reason
    from bets b left join o on b.race_id = o.race_id and b.pool = o.pool and b.combo = o.combo left join sc on sc.race_id = b.race_id and sc.combo = b.combo""")  # fmt: skip
def g1(t: Tables) -> DataFrame:
    return S.settle_bets(_bets(t), t.payouts, t.starts, t.starts.where("finish_position <= 5")).withColumn("refund", F.col("refund").cast("long"))


@query("G2_normalize_selection", """
    select ticket_id, case ticket_id % 4 when 0 then 'win' when 1 then 'exacta' when 2 then 'bracket_quinella' else 'trio' end as pool,
      case ticket_id % 4 when 0 then lpad(cast(user_id % 18 + 1 as varchar), 2, '0') when 1 then lpad(cast(user_id % 18 + 1 as varchar), 2, '0') || lpad(cast(cost % 18 + 1 as varchar), 2, '0')
        when 2 then cast(user_id % 8 + 1 as varchar) || cast(cost % 8 + 1 as varchar) else '040507' end as combo from tickets""")  # fmt: skip
def g2(t: Tables) -> DataFrame:
    k = F.col("ticket_id") % 4
    pool = F.when(k == 0, "win").when(k == 1, "exacta").when(k == 2, "bracket_quinella").otherwise("trio")
    u, c = (F.col("user_id") % 18 + 1).cast("string"), (F.col("cost") % 18 + 1).cast("string")
    sel = F.when(k == 0, u).when(k == 1, F.concat_ws("-", u, c)).when(k == 2, F.concat_ws("-", (F.col("user_id") % 8 + 1).cast("string"), (F.col("cost") % 8 + 1).cast("string"))).otherwise("040507")
    return t.tickets.select("ticket_id", pool.alias("pool"), sel.alias("sel")).select("ticket_id", "pool", S.normalize_selection(F.col("sel"), F.col("pool")).alias("combo"))


PL = "pl as (select race_id, least(finish_position, 3) as position, runner from starts where finish_position <= 4)"


@query("G4_expand_placings", f"with {PL} select a.race_id, concat_ws('-', a.runner, b.runner, c.runner) as o from pl a left join pl b on a.race_id = b.race_id and b.position = 2 left join pl c on a.race_id = c.race_id and c.position = 3 where a.position = 1")
def g4(t: Tables) -> DataFrame:
    pl = t.starts.where("finish_position <= 4").select("race_id", F.least("finish_position", F.lit(3)).alias("position"), "runner")
    return S.expand_placings(pl).select("race_id", F.array_join(F.col("order").cast("array<string>"), "-").alias("o"))


@query("G5_line_hits", """
    with o as (select race_id, list(runner order by finish_position) as ord from starts where finish_position <= 3 group by 1 having count(*) = 3),
    k as (select race_id, ord, kind, case when kind in ('trifecta', 'trio') then [1, 2, 3] else [1, 2] end as combo from o cross join (select unnest(['exacta', 'trifecta', 'quinella', 'trio', 'wide']) as kind))
    select race_id, kind, case kind when 'exacta' then combo = ord[1:2] when 'trifecta' then combo = ord when 'quinella' then list_sort(ord[1:2]) = combo when 'trio' then list_sort(ord) = combo else list_contains(ord, 1) and list_contains(ord, 2) end as hit from k""")  # fmt: skip
def g5(t: Tables) -> DataFrame:
    o = t.starts.where("finish_position <= 3").groupBy("race_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("finish_position", "runner"))), lambda z: z["runner"]).alias("ord")).where("size(ord) = 3")
    k = o.withColumn("kind", F.explode(F.array(*map(F.lit, ("exacta", "trifecta", "quinella", "trio", "wide")))))
    k = k.withColumn("combo", F.when(F.col("kind").isin("trifecta", "trio"), F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array(F.lit(1), F.lit(2))))
    return k.select("race_id", "kind", S.line_hits(F.col("kind"), F.col("combo"), F.col("ord")).alias("hit"))


@query("G6_resolve_tickets", """
    with tk as (select race_id as ticket_id, race_id, 'quinella' as type, runner as a, runner + 1 as b, 100.0::double as unit, 250.0::double as est from starts where runner <= 4),
    top as (select race_id, max(case when finish_position = 1 then runner end) as r1, max(case when finish_position = 2 then runner end) as r2 from starts where race_id % 3 <> 0 group by 1),
    pay as (select race_id, least(r1, r2) || '-' || greatest(r1, r2) as name, 700 as yen from top where r2 is not null and race_id % 2 = 0),
    sc as (select race_id, runner from starts where win_odds > 48),
    l as (select tk.*, top.race_id is null as open, s1.race_id is not null or s2.race_id is not null as void, (least(r1, r2) = a and greatest(r1, r2) = b) as hit0, coalesce(yen * unit / 100, est) as paid
      from tk left join top on tk.race_id = top.race_id left join pay on pay.race_id = tk.race_id and pay.name = a || '-' || b
      left join sc s1 on s1.race_id = tk.race_id and s1.runner = a left join sc s2 on s2.race_id = tk.race_id and s2.runner = b),
    m as (select *, coalesce(hit0 and not void, false) as hit from l),
    g as (select ticket_id, bool_or(open) as open, bool_and(void) as void, bool_or(hit) as hit, sum(case when hit then paid else 0 end) as won, sum(unit) as cost from m group by 1)
    select ticket_id, case when open then 'open' when void then 'refunded' when hit then 'won' else 'miss' end as state, cast(case when open then null when void then cost else won end as double) as returned from g""")  # fmt: skip
def g6(t: Tables) -> DataFrame:
    s = t.starts
    lines = s.where("runner <= 4").select(F.col("race_id").alias("ticket_id"), "race_id", F.lit("quinella").alias("type"), F.array(F.col("runner"), F.col("runner") + 1).alias("combo"), F.lit(100.0).alias("unit"), F.lit(250.0).alias("est"))
    orders = s.where("race_id % 3 <> 0 and finish_position <= 3").groupBy("race_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("finish_position", "runner"))), lambda z: z["runner"]).alias("order"))
    pays = orders.where("size(order) >= 2 and race_id % 2 = 0").select("race_id", F.lit("quinella").alias("pool"), F.array_join(F.array_sort(F.slice("order", 1, 2)).cast("array<string>"), "-").alias("combo"), F.lit(700).alias("payout_yen"))
    return S.resolve_tickets(lines, orders, pays, s.where("win_odds > 48").select("race_id", "runner"))


@query("G8_top_placings", "select race_id, array_to_string(list(runner order by finish_position) filter (where finish_position <= 3), '-') as top from starts group by 1")
def g8(t: Tables) -> DataFrame:
    top = R.top_k(t.starts, ["race_id"], ["finish_position"], 3)
    return top.groupBy("race_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finish_position", "runner"))), lambda z: z["runner"].cast("string")), "-").alias("top"))


@query("G10_freeze_curve", """
    with l as (select race_id, max(available_at) - interval '3 hours' as dec from odds_ts group by 1),
    b as (select o.race_id, runner, arg_min(win_odds, available_at) as open_odds, arg_max(win_odds, available_at) as close_odds, arg_max(win_odds, available_at) filter (where available_at <= dec) as decision_odds from odds_ts o join l on o.race_id = l.race_id group by 1, 2)
    select race_id, runner, open_odds, decision_odds, close_odds, round((1 / open_odds) / sum(1 / open_odds) over w, 9) as p_open, round((1 / decision_odds) / sum(1 / decision_odds) over w, 9) as p_decision,
      round((1 / close_odds) / sum(1 / close_odds) over w, 9) as p_close, round(ln(close_odds / decision_odds), 8) as clv_logdrift from b window w as (partition by race_id)""")  # fmt: skip
def g10(t: Tables) -> DataFrame:
    f = S.freeze_curve(t.odds_ts, "race_id", "runner", "available_at", "win_odds", "3 hours")
    return f.select("race_id", "runner", "open_odds", "decision_odds", "close_odds", *[F.round(c, 9).alias(c) for c in ("p_open", "p_decision", "p_close")], F.round("clv_logdrift", 8).alias("clv_logdrift"))


@query("G11_settle_curve", """
    select s.race_id, s.runner, s.win_odds as close_odds, r.fp as finish_position, r.fp = 1 as won, case when r.fp is not null then coalesce(r.o, s.win_odds) end as settle_odds,
      case when r.fp is not null then case when r.fp = 1 then coalesce(r.o, s.win_odds) else 0.0 end end as settled_payout, r.fp is not null as settled
    from starts s left join (select race_id, runner, finish_position as fp, case when runner % 2 = 0 then win_odds + 1 end as o from starts where finish_position <= 3) r on s.race_id = r.race_id and s.runner = r.runner""")  # fmt: skip
def g11(t: Tables) -> DataFrame:
    r = t.starts.where("finish_position <= 3").select("race_id", "runner", "finish_position", F.when(F.col("runner") % 2 == 0, F.col("win_odds") + 1).alias("final_odds"))
    return S.settle_curve(t.starts.select("race_id", "runner", F.col("win_odds").alias("close_odds")), r, ["race_id", "runner"])
