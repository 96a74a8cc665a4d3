"""Queries over what is composed of other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compose as C
from ..operators import evaluate as K
from ..operators import features as H
from ..operators import market as M
from ..operators import ordering as O
from ..operators import relational as R
from ..operators import settlement as S
from .bindings import Tables
from .feature_queries import h6
from .market_queries import BETS, P, SEQ3, _bets, _p
from .registry import query
from .relational_queries import WIN


@query("U1_group_predictor", "select race_id, runner, round(1.0 / win_odds, 9) as score from starts")
def u1(t: Tables) -> DataFrame:
    return C.score_groups(t.once("starts").select("race_id", "runner", "win_odds"), "race_id", "runner", lambda g: 1.0 / g["win_odds"]).withColumn("score", F.round("score", 9))


@query("U3_parameterised_sql", "select race_id, count(*) as n from starts where win_odds >= 30 group by 1")
def u3(t: Tables) -> DataFrame:
    return C.run_sql(t.spark, "select race_id, count(*) as n from {s} where win_odds >= :least group by race_id", {"s": t.starts}, least=30)


@query("K3_predictor_ranks", "select race_id, runner from (select *, row_number() over (partition by race_id order by 1.0 / win_odds desc, runner) as rn from starts) where rn = 1")
def k3(t: Tables) -> DataFrame:
    s = t.starts.withColumn("score", C.predictor("odds")())
    return R.top_k(s, ["race_id"], [F.desc("score"), "runner"], 1).select("race_id", "runner")


@query("H2_market_probs")
def h2(t: Tables) -> DataFrame:
    out = C.market_probs(t.starts, "race_id", "runner", "win_odds", "finish_position", "race_date", "available_at", H.BETAS)
    return out.select("race_id", "runner", "p", "market_beta", "calibrated_market_prob")


def _trailing(name: str, keys: str) -> str:
    on = " and ".join(f"q.{k} = h.{k}" for k in keys.split(", "))
    return f"""{name} as (select q.*, coalesce(sum(n), 0) as n, sum(w) as w, sum(p) as p from (select distinct {keys}, race_date from starts) q left join
        (select {keys}, race_date, available_at, count(*) as n, {WIN} as w, sum(case when finish_position <= 3 then 1 else 0 end) as p from starts group by all) h
        on {on} and h.race_date < q.race_date and h.available_at <= q.race_date and h.race_date >= q.race_date - interval '365 days' group by all)"""


@query("H7_handicap_features", f"""
    with h as (select distinct horse_id, race_date from starts),
    r as (select h.*, s.race_date as d, s.finish_position as fp, s.finish_time_seconds as ft, row_number() over (partition by h.horse_id, h.race_date order by s.race_date desc, s.race_id desc, s.runner desc) as rn
        from h join starts s on s.horse_id = h.horse_id and s.race_date < h.race_date and s.available_at <= h.race_date),
    f as (select horse_id, race_date, max(case when rn = 1 then fp end) as lp, max(case when rn = 1 then ft end) as lt, max(case when rn = 1 then date_diff('day', d, race_date) end) as ds,
        avg(case when rn <= 5 then fp end) as p5, avg(case when rn <= 5 then ft end) as t5, sum(case when fp = 1 then 1 else 0 end) as w10, count(*) as n10 from r where rn <= 10 group by 1, 2),
    b as (select distinct racecourse, surface, going_wetness, year(race_date) as y from starts),
    par as (select b.*, median(s.finish_time_seconds) as par from b join starts s on b.racecourse is not distinct from s.racecourse and b.surface is not distinct from s.surface and b.going_wetness is not distinct from s.going_wetness and year(s.race_date) < b.y group by all),
    own as (select q.*, avg(s.finish_time_seconds) as own from (select distinct horse_id, race_date, racecourse, surface, going_wetness from starts) q join starts s on q.horse_id = s.horse_id and s.race_date < q.race_date and s.available_at <= q.race_date
        and q.racecourse is not distinct from s.racecourse and q.surface is not distinct from s.surface and q.going_wetness is not distinct from s.going_wetness group by all),
    {_trailing("e", "horse_id")}, {_trailing("t", "trainer_id")}, {_trailing("j", "jockey_id")}, {_trailing("c", "trainer_id, jockey_id")}, {_trailing("k", "jockey_id, racecourse")}
    select s.race_id, s.runner, cast(lp as int) as last_finish_pos, lt as last_finish_time_sec, cast(ds as int) as days_since_last_race, round(p5, 9) as avg_finish_pos_5, round(t5 + 1e-9, 5) as avg_finish_time_sec_5,
        cast(coalesce(w10, 0) as bigint) as wins_last_10, cast(coalesce(n10, 0) as bigint) as starts_last_10, round(own - par + 1e-9, 5) + 0.0 as finish_time_par_delta, cast(e.n as bigint) as horse_starts_365d,
        cast(t.n as bigint) as trainer_starts_365d, round(t.w / t.n, 9) as trainer_winrate_365d, round(t.p / t.n, 9) as trainer_top3rate_365d,
        cast(j.n as bigint) as jockey_starts_365d, round(j.w / j.n, 9) as jockey_winrate_365d, round(j.p / j.n, 9) as jockey_top3rate_365d,
        cast(c.n as bigint) as trainer_jockey_combo_starts_365d, round(c.w / c.n, 9) as trainer_jockey_combo_winrate_365d,
        cast(k.n as bigint) as jockey_track_starts_365d, round(k.w / k.n, 9) as jockey_track_winrate_365d, count(*) over (partition by s.race_id) as field_size,
        case when s.surface = 'O' then 1 else 0 end as surface_turf, case when s.race_id % 3 = 0 then 1 else 0 end as is_filtered_name_match
    from starts s left join f using (horse_id, race_date) left join e using (horse_id, race_date) left join t using (trainer_id, race_date) left join j using (jockey_id, race_date)
        left join c using (trainer_id, jockey_id, race_date) left join k using (jockey_id, racecourse, race_date) left join own using (horse_id, race_date, racecourse, surface, going_wetness)
        left join par on par.racecourse is not distinct from s.racecourse and par.surface is not distinct from s.surface and par.going_wetness is not distinct from s.going_wetness and par.y = year(s.race_date)""")  # fmt: skip
def h7(t: Tables) -> DataFrame:
    named = F.when(F.col("race_id") % 3 == 0, F.concat(F.lit("Spring Cup "), F.col("race_id"))).when(F.col("race_id") % 3 == 1, F.lit("Maiden"))
    out = C.handicap_features(t.once("starts").withColumn("race_name", named), turf="O", keep=[])
    rates = [c for c in out.columns if ("_winrate_" in c or "_top3rate_" in c) and c.split("_")[0] != "horse" and c not in ("trainer_jockey_combo_top3rate_365d", "jockey_track_top3rate_365d")]
    counts = ["wins_last_10", "starts_last_10", *[c for c in out.columns if "_starts_" in c], "field_size"]
    return out.select(
        "race_id", "runner", F.col("last_finish_pos").cast("int").alias("last_finish_pos"), "last_finish_time_sec", "days_since_last_race", F.round("avg_finish_pos_5", 9).alias("avg_finish_pos_5"),
        F.round(F.col("avg_finish_time_sec_5") + 1e-9, 5).alias("avg_finish_time_sec_5"), *[F.col(c).cast("long").alias(c) for c in counts],
        (F.round(F.col("finish_time_par_delta") + 1e-9, 5) + 0.0).alias("finish_time_par_delta"), *[F.round(c, 9).alias(c) for c in rates], "surface_turf", "is_filtered_name_match",
    )


@query("D18_settlement_equivalence", f"with {BETS}, o as (select race_id, combo, max(payout_yen) as y from payouts group by 1, 2) select b.race_id, b.pool, b.combo, b.stake, 'official_payout' as reason_a, 'loss' as reason_b from bets b join o on b.race_id = o.race_id and b.combo = o.combo where b.race_id % 3 = 0")
def d18(t: Tables) -> DataFrame:
    return C.settlement_equivalence(_bets(t), t.payouts, t.payouts.where("race_id % 3 <> 0"), t.starts, t.starts)


@query("G3_build_result", "select race_id, string_agg(cast(runner as varchar), ',' order by finish_position) as top3, 1 as n_payouts from starts where finish_position <= 3 group by 1")
def g3(t: Tables) -> DataFrame:
    out = S.build_result(t.starts.where("finish_position <= 3").select("race_id", F.col("finish_position").alias("position"), "runner"), t.payouts)
    return out.select("race_id", F.array_join(F.transform("placings", lambda z: z["runners"][0].cast("string")), ",").alias("top3"), F.size("payouts").alias("n_payouts"))


@query("G9_settle_sweep", """
    with k as (select ticket_id, user_id, cost, state, cast(returned as double) as returned, case when user_id % 5 = 0 then 'g' else 'h' end as seen, user_id % 7 <> 0 as snap,
        case when ticket_id % 3 = 0 then 'open' when user_id % 2 = 0 then 'won' else 'miss' end as s from tickets),
    d as (select *, case when s = 'won' then cast(cost as double) end as r from k where s <> 'open' and (state = 'open' or snap and seen <> 'h'))
    select ticket_id, state as old_state, s as new_state, r as new_returned, case when snap then 'snapshot' else 'archive' end as source,
        case when state = 'open' then 'settled' when state <> s then 'state' when returned is distinct from r then 'amount' else 'hash' end as kind
    from d order by snap desc, ticket_id limit 500""")  # fmt: skip
def g9(t: Tables) -> DataFrame:
    k = t.tickets.select("ticket_id", "user_id", "cost", "state", F.col("returned").cast("double").alias("returned"), F.col("user_id").alias("race_id"), F.when(F.col("user_id") % 5 == 0, "g").otherwise("h").alias("seen_hash"))
    won = F.when(F.col("ticket_id") % 3 == 0, "open").when(F.col("user_id") % 2 == 0, "won").otherwise("miss")
    resolved = k.select("ticket_id", "race_id", won.alias("state"), F.when(won == "won", F.col("cost")).cast("double").alias("returned"))
    stored = k.where("race_id % 7 <> 0").select("race_id", F.lit("h").alias("hash")).distinct()
    return C.settle_sweep(k, resolved, stored, 500, archived=resolved)


@query("G13_settle_model_card", f"with {P}, r as (select *, row_number() over (partition by race_id order by p desc, runner) as rk from pr), y as (select race_id, combo, max(payout_yen) as y from payouts group by 1, 2) select r.race_id, r.runner, r.finish_position = 1 as won, case when rk = 1 then cast(coalesce(y, 0) as bigint) end as pick_payout from r left join y on y.race_id = r.race_id and y.combo = lpad(cast(r.runner as varchar), 2, '0')")
def g13(t: Tables) -> DataFrame:
    card = M.devig(t.starts, ["race_id"], "win_odds").select("race_id", "runner", "p")
    return C.settle_model_card(card, "p", t.payouts, t.starts, t.starts).select("race_id", "runner", "won", "pick_payout")


@query("I3_horse_form", "select s.race_id, s.runner, s.horse_id, c_name as trainer, rank() over (partition by s.race_id order by finish_time_seconds nulls last) as speed_rank, count(*) over (partition by s.race_id) as field_size from starts s left join customer on c_custkey = trainer_id")
def i3(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("race_id")
    s = t.starts.withColumn("speed_rank", F.rank().over(w.orderBy(F.col("finish_time_seconds").asc_nulls_last()))).withColumn("field_size", F.count(F.lit(1)).over(w))
    names = t.customer.select(F.col("c_custkey").alias("trainer_id"), F.col("c_name").alias("trainer"))
    return s.join(names, "trainer_id", "left").select("race_id", "runner", "horse_id", "trainer", "speed_rank", "field_size")


@query("I15_pattern_of_life", """
    with o as (select race_id, runner, arg_min(win_odds, available_at) as open_odds, arg_max(win_odds, available_at) as close_odds from odds_ts group by 1, 2),
    m as (select *, ln(close_odds / open_odds) as move, (close_odds >= 10)::int + (close_odds >= 40)::int as band from o), b as (select band, median(move) as med from m group by 1),
    d as (select m.*, med, abs(move - med) as off from m join b on m.band = b.band), s as (select band, median(off) as mad from d group by 1),
    z as (select race_id, runner, coalesce(case when mad <> 0 then (move - med) / (1.4826 * mad) end <= -1.5, false) as plunge from d join s on d.band = s.band), r as (select avg(plunge::int) as r from z)
    select 'runner' as role, runner as id, count(*) as n, count(*) filter (where plunge) as hits, round((count(*) filter (where plunge) * 1.0::double / count(*) - max(r)) / nullif(sqrt(max(r) * (1 - max(r)) / count(*)), 0), 6) as z from z, r group by 2 having count(*) >= 20""")  # fmt: skip
def i15(t: Tables) -> DataFrame:
    o = t.odds_ts.groupBy("race_id", "runner").agg(F.min_by("win_odds", "available_at").alias("open_odds"), F.max_by("win_odds", "available_at").alias("close_odds"))
    return C.pattern_of_life(o, o.select("race_id", "runner"), ["runner"], [10, 40], 1.5, 20).withColumn("z", F.round("z", 6))


@query("I18_race_detail", "select race_id, min(race_date) as race_date, count(*) as n_entries, sum(case when win_odds < 10 then 1 else 0 end) as short from starts group by 1")
def i18(t: Tables) -> DataFrame:
    rows = t.starts.groupBy("race_id").agg(F.min("race_date").alias("race_date"), F.array_sort(F.collect_list(F.struct("runner", "horse_id", "win_odds"))).alias("entries"))
    return rows.select("race_id", "race_date", F.size("entries").cast("long").alias("n_entries"), F.size(F.filter("entries", lambda z: z["win_odds"] < 10)).cast("long").alias("short"))


@query("J9_wide_ticket_stats", f"""with {SEQ3}, tr as (select race_id, list_sort([a, b, c])[1] as a, list_sort([a, b, c])[2] as b, list_sort([a, b, c])[3] as c, sum(prob) as prob from seq group by 1, 2, 3, 4),
    l as (select race_id, 1 as a, 2 as b, 5.0::double as payout from starts group by 1 union all select race_id, 1, 3, 7.0 from starts group by 1),
    w as (select tr.race_id, tr.a, tr.b, tr.c, max(prob) as p, count(*) as n, sum(payout) as y from tr join l on l.race_id = tr.race_id and ((l.a = tr.a and l.b = tr.b) or (l.a = tr.a and l.b = tr.c) or (l.a = tr.b and l.b = tr.c)) group by 1, 2, 3, 4)
    select race_id as ticket, round(sum(p), 8) as hit_prob, round(sum(p * n), 8) as exp_lines, max(y) as best_case from w group by 1""")  # fmt: skip
def j9(t: Tables) -> DataFrame:
    r = t.starts.select("race_id").distinct()
    lines = r.select(F.col("race_id").alias("ticket"), "race_id", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(5.0).alias("payout")), F.struct(F.lit(1).alias("a"), F.lit(3).alias("b"), F.lit(7.0).alias("payout")))).alias("x")).select("ticket", "race_id", "x.*")
    out = C.wide_ticket_stats(lines, O.combos(_p(t), "race_id", "runner", "p", "trio"))
    return out.withColumns({"hit_prob": F.round("hit_prob", 8), "exp_lines": F.round("exp_lines", 8)})


QP = "q as (select a.race_id, a.runner as a, b.runner as b, a.p * b.p / (1 - a.p) as prob from pr a join pr b on a.race_id = b.race_id and a.runner <> b.runner)"


def _scored(t: Tables) -> DataFrame:
    c = O.combos(_p(t), "race_id", "runner", "p", "exacta", 1.0)
    marks = t.starts.where("going_wetness = 1").select("race_id", F.col("runner").alias("item"), F.lit(1.0).alias("bonus"))
    return O.price(C.score_combos(c, marks, {"prob": 2.0, "odds": 0.1, "mark": 0.5}, "race_id"), "exacta")


SC = f"{P}, {QP}, mk as (select race_id, runner from starts where going_wetness = 1), sc as (select q.*, round(2 * prob + 0.1 * ln(1 / prob) + 0.5 * ((m.runner is not null)::int + (n.runner is not null)::int), 7) as score, round(0.75 / prob, 6) as est from q left join mk m on m.race_id = q.race_id and m.runner = a left join mk n on n.race_id = q.race_id and n.runner = b where prob > 0)"


@query("J13_score_combos", f"with {SC} select race_id, a, b, score from sc")
def j13(t: Tables) -> DataFrame:
    return _scored(t).select("race_id", "a", "b", F.round("score", 7).alias("score"))


#: Name, personality and flavour.
STYLES = [("steady", "safe", "chalk"), ("even", "balanced", "balanced"), ("contrarian", "antiChalk", "value"), ("dreamer", "longshot", "value")]


@query("J13_score_styles", f"""with {P}, mk as (select race_id, runner, case when runner = 1 and race_id % 5 = 0 then 'anchor' when win_odds > 45 then 'avoid' when going_wetness = 1 then 'like' when going_wetness = 2 then 'distrust' when win_odds > 30 then 'priceHorse' end as mark from starts),
    f as (select pr.race_id, pr.runner, p, mark, case when row_number() over (partition by pr.race_id order by p desc, pr.runner) <= greatest(2, ceil(count(*) over (partition by pr.race_id) / 3)) then 1 else 0 end as fav,
        case mark when 'like' then 0.25::double when 'priceHorse' then 0.3 when 'anchor' then 0.5 when 'distrust' then -0.3 else 0 end as bonus, count(*) filter (where mark = 'anchor') over (partition by pr.race_id) as anchors
        from pr join mk on pr.race_id = mk.race_id and pr.runner = mk.runner),
    q as (select a.race_id, a.runner as a, b.runner as b, a.p * b.p / (1 - a.p) + a.p * b.p / (1 - b.p) as prob, 1 - (a.p + b.p) / 2 as against, a.fav + b.fav as fav, a.bonus + b.bonus as bonus
        from f a join f b on a.race_id = b.race_id and a.runner < b.runner where a.mark is distinct from 'avoid' and b.mark is distinct from 'avoid'
        and (case when a.mark = 'anchor' then 1 else 0 end) + (case when b.mark = 'anchor' then 1 else 0 end) = a.anchors),
    st as (select * from (values ('steady', 'safe', 'chalk', 7.0::double, 0.08::double), ('even', 'balanced', 'balanced', 4, 0.35), ('contrarian', 'antiChalk', 'value', 4, 0.35), ('dreamer', 'longshot', 'value', 1.3, 0.95)) v(style, who, flavour, hit, pay))
    select race_id, a, b, style, case fav when 2 then 'chalk' when 0 then 'value' else 'blend' end as tag, round(prob * hit + ln(greatest(1, 1 / prob)) * pay + bonus
        + case flavour when 'value' then against * 0.32 when 'chalk' then (1 - against) * 0.32 else 0 end - case when fav = 2 and who = 'antiChalk' then 0.55 else 0 end
        - case when fav = 2 and who <> 'safe' then 0.25 else 0 end + case when who <> 'balanced' then 0 when fav = 1 then 0.45 else -0.3 end, 6) as score
    from q cross join st where prob > 0""")  # fmt: skip
def j13_styles(t: Tables) -> DataFrame:
    mark = F.when((F.col("runner") == 1) & (F.col("race_id") % 5 == 0), "anchor").when(F.col("win_odds") > 45, "avoid").when(F.col("going_wetness") == 1, "like").when(F.col("going_wetness") == 2, "distrust").when(F.col("win_odds") > 30, "priceHorse")
    pairs = O.combos(_p(t), "race_id", "runner", "p", "quinella", 1.0)
    out = C.score_styles(pairs, _p(t), t.starts.select("race_id", "runner", mark.alias("mark")), STYLES, "race_id", "runner", "p", ["a", "b"])
    return out.select("race_id", "a", "b", "style", "tag", F.round("score", 6).alias("score"))


@query("J14_trim_lines", f"""with {SC}, w as (select *, count(*) over o as n, max(est) over o as best from sc window o as (partition by race_id order by score desc, a, b rows between unbounded preceding and current row)),
    x as (select *, max(case when best <= n or n > 5 then 1 else 0 end) over (partition by race_id order by score desc, a, b rows between unbounded preceding and current row) as bad from w) select race_id, a, b from x where bad = 0""")  # fmt: skip
def j14(t: Tables) -> DataFrame:
    return C.trim_lines(_scored(t).withColumns({"score": F.round("score", 7), "est_payout": F.round("est_payout", 6)}), ["race_id"], ["a", "b"], 1.0, 5).select("race_id", "a", "b")


@query("J15_rank_tickets", "select user_id, state, ticket_id, place from (select *, row_number() over (partition by user_id order by cost desc, state) as place from (select *, row_number() over (partition by user_id, state order by cost desc, ticket_id) as r1 from tickets) where r1 = 1) where place <= 3")
def j15(t: Tables) -> DataFrame:
    one = R.top_k(t.tickets, ["user_id", "state"], [F.desc("cost"), "ticket_id"], 1)
    return C.rank_tickets(one, "user_id", "state", "cost").select("user_id", "state", "ticket_id", "place")


@query("K14_cells", f"select cell, count(*) as n, {WIN} as wins, case when count(*) < 20000 then 'thin' end as reason from (select finish_position, 'all' as cell from starts union all select finish_position, 'wet' from starts where going_wetness >= 3 union all select finish_position, 'long' from starts where win_odds > 30) group by 1")
def k14(t: Tables) -> DataFrame:
    flags = {"all": F.lit(True), "wet": F.col("going_wetness") >= 3, "long": F.col("win_odds") > 30}
    return C.cells(t.starts, flags, [F.count_if(F.col("finish_position") == 1).alias("wins")], 20000)


W2 = "w as (select race_id, max(case when finish_position = 1 then runner end) as a, max(case when finish_position = 2 then runner end) as b from starts group by 1)"


@query("K15_exotic_calibration", f"with {P}, {QP}, {W2}, j as (select prob, cast(least(9, floor(-log10(round(prob, 12)) * 2)) as int) as bin, w.race_id as hit from q left join w on w.race_id = q.race_id and w.a = q.a and w.b = q.b where prob > 0) select bin, count(*) as n, round(avg(prob), 9) as mean_prob, count(hit) as hits from j group by 1")
def k15(t: Tables) -> DataFrame:
    c = O.combos(_p(t), "race_id", "runner", "p", "exacta", 1.0).withColumn("prob", F.round("prob", 12))
    pick = lambda k: F.max(F.when(F.col("finish_position") == k, F.col("runner")))
    w = t.starts.groupBy("race_id").agg(pick(1).alias("a"), pick(2).alias("b"))
    return C.exotic_calibration(c, w, "race_id", ["a", "b"]).withColumn("mean_prob", F.round("mean_prob", 9))


@query("K15_exotic_likelihood", f"""with {P},
    g as (select *, pow(p, gamma) as s, sum(pow(p, gamma)) over (partition by race_id) as t, sum(p) over (partition by race_id) as o from (select race_id, runner, p, 0.8 + 0.05 * (race_id % 3) as gamma from pr where p > 0)),
    ex as (select a.race_id, a.runner as a, b.runner as b, a.p / a.o * b.p / (b.o - a.p) as h, a.p / a.o * b.s / (b.t - a.s) as g from g a join g b on a.race_id = b.race_id and a.runner <> b.runner),
    tf as (select a.race_id, a.runner as a, b.runner as b, c.runner as c, a.p / a.o * b.p / (b.o - a.p) * c.p / (c.o - a.p - b.p) as h, a.p / a.o * b.s / (b.t - a.s) * c.s / (c.t - a.s - b.s) as g
           from g a join g b on a.race_id = b.race_id and a.runner <> b.runner join g c on c.race_id = a.race_id and c.runner <> a.runner and c.runner <> b.runner),
    tr as (select race_id, list_sort([a, b, c]) as x, sum(h) as h, sum(g) as g from tf group by 1, 2),
    w as (select race_id, max(case when finish_position = 1 then runner end) as a, max(case when finish_position = 2 then runner end) as b, max(case when finish_position = 3 then runner end) as c from starts group by 1),
    every as (select 'exacta' as pool, ex.race_id, h, g, ex.a = w.a and ex.b = w.b as hit from ex join w on ex.race_id = w.race_id where w.b is not null
              union all select 'trifecta', tf.race_id, h, g, tf.a = w.a and tf.b = w.b and tf.c = w.c from tf join w on tf.race_id = w.race_id where w.c is not null
              union all select 'trio', tr.race_id, h, g, x = list_sort([w.a, w.b, w.c]) from tr join w on tr.race_id = w.race_id where w.c is not null)
    select pool, count(distinct race_id) as races, count(*) as combos, round(sum(case when hit then ln(greatest(h, 1e-12)) end), 4) as harville_ll, round(sum(case when hit then ln(greatest(g, 1e-12)) end), 4) as henery_ll from every where g > 0 group by 1""")  # fmt: skip
def k15_likelihood(t: Tables) -> DataFrame:
    pick = lambda k: F.max(F.when(F.col("finish_position") == k, F.col("runner")))
    w = t.starts.groupBy("race_id").agg(*[pick(k + 1).alias(n) for k, n in enumerate("xyz")])
    ordered = F.array_sort(F.when(F.col("z").isNotNull(), F.array("x", "y", "z")))
    w = w.select("*", *[ordered[k].alias(n) for k, n in enumerate("uvw")])
    probs = _p(t).withColumn("gamma", 0.8 + 0.05 * (F.col("race_id") % 3))
    pools = {"exacta": ["x", "y"], "trifecta": ["x", "y", "z"], "trio": ["u", "v", "w"]}
    return C.exotic_likelihood(probs, w, "race_id", "runner", "p", pools, F.col("gamma")).withColumns({c: F.round(c, 4) for c in ("harville_ll", "henery_ll")})


@query("K16_exotic_efficiency", f"with {P}, j as (select pr.*, s.win_odds, pow(p, 0.9) * s.win_odds as ratio, y from pr join starts s on s.race_id = pr.race_id and s.runner = pr.runner left join (select race_id, combo, max(payout_yen) as y from payouts group by 1, 2) y on y.race_id = pr.race_id and y.combo = lpad(cast(pr.runner as varchar), 2, '0')) select tau, count(*) as bets, round(sum(coalesce(y, 0) / 100.0), 4) as returned, round(sum(coalesce(y, 0) / 100.0) / count(*) - 1, 7) as roi from j cross join (select unnest([1.0, 5.0, 10.0])::double as tau) where ratio >= tau group by 1")
def k16(t: Tables) -> DataFrame:
    m = _p(t).select("race_id", "runner", F.pow("p", F.lit(0.9)).alias("prob"))
    pays = t.payouts.groupBy("race_id", F.col("combo").cast("int").alias("runner")).agg(F.max("payout_yen").alias("payout_yen"))
    out = C.exotic_efficiency(m, t.starts.select("race_id", "runner", "win_odds"), pays, ["race_id", "runner"], "win_odds", [1.0, 5.0, 10.0])
    return out.withColumns({"returned": F.round("returned", 4), "roi": F.round("roi", 7)})


@query("K17_realized_edge", f"with {P}, j as (select p / (100.0 / payout_yen) as e, case when payout_yen > 0 and payout_yen <= 1000 then 0 when payout_yen <= 3000 then 1 when payout_yen <= 10000 then 2 end as bucket from pr join payouts y on y.race_id = pr.race_id and cast(y.combo as int) = pr.runner) select bucket, count(*) as n, round(avg(e), 7) as mean_edge, round(median(e), 7) as median_edge, round(avg(ln(e)), 7) as log_edge from j where bucket is not null group by 1")
def k17(t: Tables) -> DataFrame:
    m = _p(t).select("race_id", "runner", F.col("p").alias("prob"))
    pays = t.payouts.select("race_id", F.col("combo").cast("int").alias("runner"), "payout_yen")
    out = C.realized_edge(m, pays, ["race_id", "runner"], [0, 1000, 3000, 10000])
    return out.withColumns({c: F.round(c, 7) for c in ("mean_edge", "median_edge", "log_edge")})


@query("K25_stability", "select year(race_date) as year, round(avg(win_odds), 7) as mean, median(win_odds) as median, count(*) as n, min(win_odds) as min, max(win_odds) as max from starts where finish_position = 1 group by 1")
def k25(t: Tables) -> DataFrame:
    return C.stability(t.starts.where("finish_position = 1"), F.year("race_date"), "win_odds").withColumn("mean", F.round("mean", 7))


@query("K18_walkforward_classifier")
def k18(t: Tables) -> DataFrame:
    d = t.starts.select("race_id", "runner", F.year("race_date").alias("y"), "going_wetness", F.ln("win_odds").alias("lo"), (F.col("finish_position") == 1).cast("double").alias("won"))
    return K.fit_classifier_walkforward(d.withColumn("going_wetness", F.col("going_wetness").cast("double")), "y", ["lo", "going_wetness"], "won", maxIter=200)


@query("K23_going_validation")
def k23(t: Tables) -> DataFrame:
    d = M.devig(t.starts, ["race_id"], "win_odds").withColumn("lp", F.ln("p")).join(h6(t).select("race_id", "runner", "wet_edge"), ["race_id", "runner"])
    return C.validate_features(d, "race_id", "race_date", "p", ["lp", "going_wetness"], ["wet_edge_z"], "win_odds", F.col("finish_position") == 1, z=["wet_edge"], since=1997)


@query("K23_training_validation")
def k23_training(t: Tables) -> DataFrame:
    """Works are earlier runs, as in H9, and the kinds of course are the surfaces."""
    d = M.devig(t.starts, ["race_id"], "win_odds").withColumn("lp", F.ln("p"))
    d = H.work_features(d, t.starts, "horse_id", "race_date", "available_at", "finish_time_seconds", ties=["race_id", "runner"])
    kinds = {"all": F.lit(True), "slope": F.col("surface") == "F", "woodchip": F.col("surface") == "O"}
    extra = ["work_recent_z", "work_accel", "work_best_z", "days_since_work"]
    return C.validate_features(d, "race_id", "race_date", "p", ["lp"], extra, "win_odds", F.col("finish_position") == 1, z=["work_recent", "work_best"], since=1997, subsets=kinds)


@query("B8_union_layouts", "select l_orderkey as id, l_shipdate as at, l_quantity as v, 'a' as layout from lineitem where l_returnflag = 'R' and l_partkey <> 1 union all select o_orderkey, o_orderdate, o_totalprice / 1000, 'b' from orders where o_orderstatus <> 'P'")
def b8(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_returnflag = 'R' and l_partkey <> 1").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("v"), F.lit("a").alias("layout"))
    b = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), (F.col("o_totalprice") / 1000).alias("v"), F.lit("b").alias("layout"))
    return a.unionByName(b)
