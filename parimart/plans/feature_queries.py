"""Queries over sections: scalar functions (S), feature tables (H) and evaluation (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import evaluate as K
from ..operators import features as H
from ..operators import market as M
from ..operators import settlement as S
from .bindings import Tables
from .market_queries import P
from .registry import query
from .relational_queries import TOP3, WIN


@query("S1_parse_time", """
    select event_id, date_trunc('second', ts) as a, date_trunc('day', ts) as b, date_trunc('second', ts) as c, cast(null as timestamp) as d from events""")  # fmt: skip
def s1(t: Tables) -> DataFrame:
    z = F.col("ts").cast("timestamp")
    forms = {"a": F.date_format(z, "yyyyMMddHHmmss"), "b": F.date_format(z, "yyyyMMdd"), "c": F.date_format(z, "yyyy-MM-dd HH:mm:ss"), "d": F.lit("soon")}
    return t.events.select("event_id", *[X.parse_time(c).alias(n) for n, c in forms.items()])


@query("S3_jst_to_utc", "select o_orderkey, o_orderdate + ((o_orderkey % 24) * interval '1 hour') + ((o_orderkey % 60) * interval '1 minute') - interval '9 hours' as utc from orders")
def s3(t: Tables) -> DataFrame:
    hhmm = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    return t.orders.select("o_orderkey", X.jst_to_utc(F.col("o_orderdate"), hhmm).alias("utc"))


@query("S4_iso_utc", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso from events")
def s4(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.iso_utc(F.col("ts")).alias("iso"))


@query("S5_iso_week", "select o_orderkey, cast(isoyear(o_orderdate) as varchar) || '-W' || lpad(cast(weekofyear(o_orderdate) as varchar), 2, '0') as week from orders")
def s5(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.iso_week(F.col("o_orderdate")).alias("week"))


@query("S7_distance_band", "select p_partkey, case when p_size * 60 < 1400 then 'sprint' when p_size * 60 < 1800 then 'mile' when p_size * 60 < 2200 then 'intermediate' when p_size is not null then 'staying' end as band from part")
def s7(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.banded(F.col("p_size") * 60).alias("band"))


RANKED = "r as (select race_id, runner, finish_position, rank() over (partition by race_id order by win_odds) as cr, count(*) over (partition by race_id) as n from starts)"


@query("S8_style_signal", f"""with {RANKED} select race_id, runner, case when cr <= case when n <= 5 then 2 else 3 end then case when finish_position <= 3 then 'presser' else 'deep_closer' end
    when finish_position <= 2 then 'speed' else 'pace_following' end as style from r""")  # fmt: skip
def s8(t: Tables) -> DataFrame:
    w = Window.partitionBy("race_id")
    r = t.starts.withColumn("cr", F.rank().over(w.orderBy("win_odds"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.select("race_id", "runner", X.style_signal(F.col("finish_position"), F.col("cr"), F.col("n")).alias("style"))


@query("S9_labels", "select o_orderkey, case o_orderstatus when 'F' then 'turf' when 'O' then 'dirt' end as surface from orders")
def s9(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.labelled(F.col("o_orderstatus"), {"F": "turf", "O": "dirt"}).alias("surface"))


@query("S10_decoders", "select o_orderkey, nullif((o_orderkey % 1000) / 10.0::double, 0) as odds, (o_orderkey % 3) * 60 + o_orderkey % 60 + (o_orderkey % 10) / 10.0::double as seconds from orders where o_orderkey % 3 + o_orderkey % 60 + o_orderkey % 10 > 0")
def s10(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    clock = F.concat((k % 3).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), (k % 10).cast("string"))
    odds = X.digits_scaled(F.lpad((k % 1000).cast("string"), 4, "0"), 10)
    return t.orders.where((k % 3 + k % 60 + k % 10) > 0).select("o_orderkey", odds.alias("odds"), X.clock_seconds(clock).alias("seconds"))


@query("S11_id_parts", "select distinct race_id, split_part(race_id, '-', 1) as pool, cast(split_part(race_id, '-', 2) as int) as year, cast(split_part(race_id, '-', 4) as int) as no from odds_ts")
def s11(t: Tables) -> DataFrame:
    part = lambda k: X.id_part(F.col("race_id"), "-", k)
    return t.odds_ts.select("race_id").distinct().select("race_id", part(1).alias("pool"), part(2).try_cast("int").alias("year"), part(4).try_cast("int").alias("no"))


@query("S12_derived_flags", "select c_custkey, 2024 - (2000 + cast(substr(c_name, -2) as int) % 24) as age, regexp_matches(c_name, '7$') as flagged, case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 else 0 end as grade from customer")
def s12(t: Tables) -> DataFrame:
    born = 2000 + F.substring("c_name", -2, 2).cast("int") % 24
    grade = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(0)
    return t.customer.select("c_custkey", (2024 - born).alias("age"), F.col("c_name").rlike("7$").alias("flagged"), grade.alias("grade"))


@query("S13_log_odds", f"with {P} select race_id, runner, round(p, 9) as p, round(ln(1 / p), 8) as log_odds, round(greatest(-10, least(10, ln(greatest(p, 1e-300) / greatest(1 - p, 1e-300)))), 7) as logit from pr")
def s13(t: Tables) -> DataFrame:
    d = M.devig(t.starts, ["race_id"], "win_odds")
    return d.select("race_id", "runner", F.round("p", 9).alias("p"), F.round(F.ln(1 / F.col("p")), 8).alias("log_odds"), F.round(X.logit(F.col("p")), 7).alias("logit"))


@query("S14_latest_source", "select race_id, runner, greatest(coalesce(race_date, timestamp '1900-01-01'), coalesce(case when runner % 2 = 0 then available_at end, timestamp '1900-01-01'), timestamp '1900-01-01') as latest from starts")
def s14(t: Tables) -> DataFrame:
    return t.starts.select("race_id", "runner", X.latest_source(F.col("race_date"), F.when(F.col("runner") % 2 == 0, F.col("available_at"))).alias("latest"))


@query("S16_clean_odds", "select event_id, case when value >= 1 then value end as odds from events")
def s16(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.clean_odds(F.col("value").cast("string")).alias("odds"))


@query("S18_json_columns", "select event_id, cast(json_extract(props, '$.k') as int) as k, split_part(event_type || '|' || user_id, '|', 2) as tail from events")
def s18(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.try_element_at(F.split(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), "\\|"), F.lit(2)).alias("tail"))


@query("S19_content_hash", "select o_orderkey, sha256(cast(o_orderkey as varchar) || '|' || o_orderstatus) as h from orders")
def s19(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("h"))


@query("S20_safe_coercion", "select event_id, coalesce(try_cast(event_type as int), -1) as a, coalesce(try_cast(cast(user_id as varchar) as int), -1) as b from events")
def s20(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.col("event_type").try_cast("int"), F.lit(-1)).alias("a"), F.coalesce(F.col("user_id").cast("string").try_cast("int"), F.lit(-1)).alias("b"))


@query("B18_crosswalk_id", "select event_id, case when event_id % 3 = 0 then '20240101-05-' || lpad(cast(event_id % 12 + 1 as varchar), 2, '0') when event_type = 'click' then '20240101-06-' || lpad(cast(event_id % 12 + 1 as varchar), 2, '0') end as canonical from events")
def b18(t: Tables) -> DataFrame:
    venue = F.when(F.col("event_id") % 3 == 0, "05").otherwise(F.col("event_type"))
    key = F.concat_ws("-", F.lit("20240101"), venue, (F.col("event_id") % 12 + 1).cast("string"))
    return t.events.select("event_id", X.crosswalk_id(key, {"click": "06"}).alias("canonical"))


@query("H1_career_features", f"""
    with h as (select horse_id, race_date, available_at, count(*) as n, {WIN} as w, {TOP3} as k from starts group by 1, 2, 3), q as (select distinct horse_id, race_date, race_date + interval '1 day' as as_of from starts),
    f as (select q.horse_id, q.race_date, sum(n) as n, sum(w) as w, sum(k) as k from q join h on q.horse_id = h.horse_id and h.race_date < q.race_date and h.available_at <= q.as_of group by 1, 2)
    select s.race_id, s.runner, cast(coalesce(n, 0) as bigint) as career_starts, cast(coalesce(w, 0) as bigint) as career_wins, cast(coalesce(k, 0) as bigint) as career_top3, w / n as win_rate, k / n as top3_rate
    from starts s left join f on s.horse_id = f.horse_id and s.race_date = f.race_date""")  # fmt: skip
def h1(t: Tables) -> DataFrame:
    out = H.career_features(t.starts.select("race_id", "runner", "horse_id", "race_date", "available_at", "finish_position"), "horse_id", "race_id", "race_date", "available_at", "finish_position", F.col("race_date") + F.expr("interval 1 day"))
    return out.select("race_id", "runner", "career_starts", "career_wins", "career_top3", "win_rate", "top3_rate")


@query("H1_open_last_odds", """
    with q as (select race_id, runner, max(post_time) - interval '2 hours' as as_of from odds_ts group by 1, 2),
    f as (select q.race_id, q.runner, arg_max(win_odds, available_at) filter (where available_at <= as_of) as last_odds, arg_min(win_odds, available_at) filter (where available_at <= as_of) as open_odds
      from q join odds_ts o on q.race_id = o.race_id and q.runner = o.runner group by 1, 2)
    select race_id, runner, last_odds, open_odds, round((last_odds - open_odds) / open_odds * 100, 7) as odds_drift_pct from f""")  # fmt: skip
def h1b(t: Tables) -> DataFrame:
    q = t.odds_ts.groupBy("race_id", "runner").agg((F.max("post_time") - F.expr("interval 2 hours")).alias("as_of"))
    out = H.open_last_odds(q, t.odds_ts, ["race_id", "runner"], "as_of", "available_at", "win_odds")
    return out.select("race_id", "runner", "last_odds", "open_odds", F.round("odds_drift_pct", 7).alias("odds_drift_pct"))


LOSS = f"""{P}, loss as (select race_id, beta, -ln(greatest(max(case when finish_position = 1 then pow(greatest(p, 1e-12), beta) end) / sum(pow(greatest(p, 1e-12), beta)), 1e-12)) as loss
    from pr cross join (select unnest([0.5, 1.0, 1.5])::double as beta) group by 1, 2)"""


def _losses(t: Tables, grid=H.BETAS, compact: bool = False) -> DataFrame:
    p = M.devig(t.starts, ["race_id"], "win_odds")
    return H.beta_losses(p, "race_id", "p", F.col("finish_position") == 1, grid, compact=compact)


@query("H3_beta_losses", f"with {LOSS} select race_id, beta, round(loss, 8) + 0.0 as loss from loss")
def h3(t: Tables) -> DataFrame:
    return _losses(t, [0.5, 1.0, 1.5]).withColumn("loss", F.round("loss", 8) + 0.0)


@query("H3_beta_losses_whole")
def h3_whole(t: Tables) -> DataFrame:
    return _losses(t).withColumn("loss", F.round("loss", 8) + 0.0)


@query("H3_beta_walkforward")
def h3b(t: Tables) -> DataFrame:
    races = t.starts.groupBy("race_id").agg(F.min("race_date").alias("as_of"), F.max("available_at").alias("known"))
    return H.fit_beta_walkforward(_losses(t, compact=True), races, "race_id", "as_of", "known", grid=H.BETAS)


@query("H8_trailing_rates", f"""
    with h as (select jockey_id, race_date, available_at, count(*) as n, {WIN} as w from starts group by 1, 2, 3), q as (select distinct jockey_id, race_date from starts),
    f as (select q.jockey_id, q.race_date, sum(n) as n, sum(w) as w from q join h on q.jockey_id = h.jockey_id and h.race_date < q.race_date and h.available_at <= q.race_date and h.race_date >= q.race_date - interval '180 days' group by 1, 2)
    select s.race_id, s.runner, cast(coalesce(n, 0) as bigint) as jockey_starts, round(w / n, 9) as jockey_win_rate from starts s left join f on s.jockey_id = f.jockey_id and s.race_date = f.race_date""")  # fmt: skip
def h8(t: Tables) -> DataFrame:
    s = t.starts.select("race_id", "runner", "jockey_id", "race_date", F.col("race_date").alias("as_of"))
    out = H.trailing_rates(s, t.starts, ["jockey_id"], "race_date", "available_at", "as_of", "finish_position", 180, "jockey")
    return out.select("race_id", "runner", "jockey_starts", F.round("jockey_win_rate", 9).alias("jockey_win_rate"))


#: The four sets of keys whose rates over a year are features.
RATE_KEYS = {"trainer": ["trainer_id"], "jockey": ["jockey_id"], "pair": ["trainer_id", "jockey_id"], "venue": ["jockey_id", "racecourse"]}


def _rates_sql(name: str, keys: list[str]) -> str:
    same = " and ".join(f"q.{k} = h.{k}" for k in keys)
    own = " and ".join(f"s.{k} = f.{k}" for k in keys)
    k, qk = ", ".join(keys), ", ".join(f"q.{c}" for c in keys)
    return f"""
    with h as (select {k}, race_date, available_at, count(*) as n, {WIN} as w, sum(case when finish_position <= 3 then 1 else 0 end) as t from starts group by {k}, race_date, available_at),
    q as (select distinct {k}, race_date from starts),
    f as (select {qk}, q.race_date, sum(n) as n, sum(w) as w, sum(t) as t from q join h on {same} and h.race_date < q.race_date and h.available_at <= q.race_date and h.race_date >= q.race_date - interval '365 days' group by {qk}, q.race_date)
    select s.race_id, s.runner, cast(coalesce(n, 0) as bigint) as {name}_starts, round(w / n, 9) as {name}_win_rate, round(t / n, 9) as {name}_top3_rate from starts s left join f on {own} and s.race_date = f.race_date"""


def _rates(name: str, keys: list[str]):
    @query(f"H8_rates_{name}", _rates_sql(name, keys))
    def run(t: Tables) -> DataFrame:
        s = t.starts.select("race_id", "runner", *keys, "race_date", F.col("race_date").alias("as_of"))
        out = H.trailing_rates(s, t.starts, keys, "race_date", "available_at", "as_of", "finish_position", 365, name)
        return out.select("race_id", "runner", f"{name}_starts", *[F.round(f"{name}_{c}", 9).alias(f"{name}_{c}") for c in ("win_rate", "top3_rate")])

    return run


for _name, _keys in RATE_KEYS.items():
    _rates(_name, _keys)


@query("H9_training_features", """
    with q as (select distinct horse_id, race_date from starts),
    w as (select q.*, s.available_at as wt, s.finish_time_seconds as v, row_number() over (partition by q.horse_id, q.race_date order by s.available_at desc, s.race_id, s.runner, s.finish_time_seconds) as rn
      from q join starts s on q.horse_id = s.horse_id and s.available_at <= q.race_date and s.available_at >= q.race_date - interval '30 days'),
    a as (select horse_id, race_date, max(case when rn = 1 then v end) as work_recent, max(case when rn = 2 then v end) as work_prior, min(v) as work_best, max(wt) as lw, count(*) as n from w group by 1, 2)
    select q.horse_id, q.race_date, work_recent, work_prior, work_best, round(work_recent - work_prior, 7) as work_accel, date_diff('day', cast(lw as date), cast(q.race_date as date)) as days_since_work, coalesce(n, 0) as works_count
    from q left join a on q.horse_id = a.horse_id and q.race_date = a.race_date""")  # fmt: skip
def h9(t: Tables) -> DataFrame:
    q = t.starts.select("horse_id", "race_date").distinct()
    out = H.work_features(q, t.starts, "horse_id", "race_date", "available_at", "finish_time_seconds", ties=["race_id", "runner"])
    return out.select("horse_id", "race_date", "work_recent", "work_prior", "work_best", F.round("work_accel", 7).alias("work_accel"), "days_since_work", "works_count")


@query("H6_going_features", f"""
    with z as (select race_id, runner, horse_id, race_date, available_at, going_wetness >= 3 as wet, case when count(finish_position) over w <= 1 then 1.0::double else 1.0::double - (finish_position - 1) / (count(finish_position) over w - 1) end as pct from starts window w as (partition by race_id)),
    d as (select horse_id, race_date, available_at, sum(case when wet then pct else 0 end) as ws, sum(wet::int) as wn, sum(case when wet then 0 else pct end) as ds, sum((not wet)::int) as dn from z group by 1, 2, 3),
    q as (select distinct horse_id, race_date from z),
    f as (select q.horse_id, q.race_date, sum(ws) as ws, sum(wn) as wn, sum(ds) as ds, sum(dn) as dn from q join d on q.horse_id = d.horse_id and d.race_date < q.race_date and d.available_at <= q.race_date group by 1, 2)
    select z.race_id, z.runner, cast(coalesce(wn, 0) as bigint) as wet_n, round((coalesce(ws, 0) + 2 * 0.5) / (coalesce(wn, 0) + 2), 8) as wet_rate, round((coalesce(ds, 0) + 2 * 0.5) / (coalesce(dn, 0) + 2), 8) as dry_rate,
      round((coalesce(ws, 0) + 1.0) / (coalesce(wn, 0) + 2) - (coalesce(ds, 0) + 1.0) / (coalesce(dn, 0) + 2), 8) + 0.0 as wet_edge from z left join f on z.horse_id = f.horse_id and z.race_date = f.race_date""")  # fmt: skip
def h6(t: Tables) -> DataFrame:
    z = t.starts.withColumn("pct", M.finish_percentile("finish_position", ["race_id"])).withColumn("wet", F.col("going_wetness") >= 3).withColumn("as_of", F.col("race_date"))
    sums = {"ws": F.when(F.col("wet"), F.col("pct")).otherwise(0.0), "wet_n": F.col("wet").cast("int"), "ds": F.when(F.col("wet"), 0.0).otherwise(F.col("pct")), "dry_n": (~F.col("wet")).cast("int")}
    out = H.prior_history(z.select("race_id", "runner", "horse_id", "race_date", "as_of"), z, "horse_id", "race_date", "available_at", "as_of", sums)
    wet, dry = H.smoothed_rate(F.col("ws"), F.col("wet_n"), F.lit(0.5), 2), H.smoothed_rate(F.col("ds"), F.col("dry_n"), F.lit(0.5), 2)
    return out.select("race_id", "runner", "wet_n", F.round(wet, 8).alias("wet_rate"), F.round(dry, 8).alias("dry_rate"), (F.round(wet - dry, 8) + 0.0).alias("wet_edge"))


@query("H10_body_weight", "select c_custkey, c_acctbal - 500 as body_weight_delta_kg, (c_acctbal - 500) / 500 as body_weight_delta_pct, case when c_acctbal <> 0 then 55.0::double / c_acctbal end as carried_to_body_weight_ratio, abs(c_acctbal - 500) >= 10 as extreme_body_weight_delta from customer")
def h10(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", *H.body_weight_features(F.col("c_acctbal"), F.lit(500.0), F.lit(55.0)))


@query("H11_relationship", f"with p as (select jockey_id, horse_id, count(*) as n, {WIN} as w, {TOP3} as k from starts group by 1, 2) select jockey_id, horse_id, w / n as pair_win_rate, k / n as pair_top3_rate, n = 0 as first_time_pairing, k / n - 0.4::double as pair_top3_lift_vs_horse, k / n - 0.3::double as pair_top3_lift_vs_jockey from p")
def h11(t: Tables) -> DataFrame:
    p = t.starts.groupBy("jockey_id", "horse_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("finish_position") == 1).alias("w"), F.count_if(F.col("finish_position") <= 3).alias("k"))
    return p.select("jockey_id", "horse_id", *H.relationship_features(F.col("n"), F.col("w"), F.col("k"), F.lit(0.4), F.lit(0.3)))


@query("H12_travel", "select c_custkey, c_nationkey % 5 <> 2 as international_travel, case when c_nationkey % 5 <> 2 then c_custkey % 30 end as recovery_days_after_international, case c_mktsegment when 'BUILDING' then 'high' when 'MACHINERY' then 'low' else 'medium' end as travel_confidence from customer")
def h12(t: Tables) -> DataFrame:
    src = F.when(F.col("c_mktsegment") == "BUILDING", "stable").when(F.col("c_mktsegment") == "MACHINERY", "unknown").otherwise("feed")
    return t.customer.select("c_custkey", *H.travel_features(F.col("c_nationkey") % 5, F.lit(2), F.col("c_custkey") % 30, src))


@query("H13_point_in_time", "select race_id, runner, available_at from starts where not (available_at > race_date + interval '60 days')")
def h13(t: Tables) -> DataFrame:
    s = t.starts.withColumn("as_of", F.col("race_date") + F.expr("interval 60 days"))
    return H.assert_point_in_time(s, "available_at", "as_of", drop=True).select("race_id", "runner", "available_at")


@query("H15_annotations", "select event_id, greatest(0.0, least(1.0, value / 50)) as confidence, case when event_type <> 'click' then 'label' when not (value / 50 between 0 and 1) then 'confidence' when user_id % 7 = 0 then 'evidence' end as reject from events")
def h15(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.when(F.col("event_type") == "click", "sweating").otherwise("guess").alias("label"), (F.col("value") / 50).alias("confidence"), F.when(F.col("user_id") % 7 != 0, "uri").alias("evidence"))
    return H.validate_annotations(e, "label", "confidence", "evidence").select("event_id", "confidence", "reject")


@query("K1_backtest", f"""with {P}, r as (select *, row_number() over (partition by race_id order by p desc, runner) as rk from pr), b as (select race_id, max(case when rk = 1 then finish_position end) as top, max(case when finish_position = 1 then 1.0::double / rk end) as rr from r group by 1)
    select count(*) as races, count(*) filter (where top = 1) as wins, count(*) filter (where top <= 3) as top3, round(sum(coalesce(rr, 0)) / count(*), 8) as mrr from b""")  # fmt: skip
def k1(t: Tables) -> DataFrame:
    return K.backtest(M.devig(t.starts, ["race_id"], "win_odds"), "race_id", "runner", F.col("p"), "finish_position").withColumn("mrr", F.round("mrr", 8))


PICK = f"""{P}, pk as (select *, row_number() over (partition by race_id order by p desc, runner) as rk from pr), pick as (select race_id, runner, p from pk where rk = 1),
    py as (select race_id, combo, max(payout_yen) as y from payouts group by 1, 2), st as (select k.race_id, 100.0::double as stake, cast(coalesce(y, 0) as double) as back from pick k left join py on py.race_id = k.race_id and py.combo = lpad(cast(k.runner as varchar), 2, '0'))"""


def _settled_picks(t: Tables) -> DataFrame:
    picks = K.top_k(M.devig(t.starts, ["race_id"], "win_odds"), ["race_id"], [F.desc("p"), "runner"], 1)
    bets = picks.select("race_id", F.lit("win").alias("pool"), F.lpad(F.col("runner").cast("string"), 2, "0").alias("combo"), F.lit(100).alias("stake"))
    return S.settle_bets(bets, t.payouts, t.starts, t.starts).select("race_id", F.col("stake").cast("double").alias("stake"), (F.col("payout") + F.col("refund")).cast("double").alias("back"))


@query("K2_roi_report", f"with {PICK} select count(*) as bets, sum(stake) as stake, sum(back) as returned, round(sum(back) / sum(stake) - 1, 4) as roi, round(sum(back) * 0.9 / sum(stake) - 1, 4) as capacity_roi, round(count(*) filter (where back > 0) / count(*), 4) as hit_rate from st")
def k2(t: Tables) -> DataFrame:
    return K.roi_report(_settled_picks(t), "stake", "back", 0.1)


@query("K2_trimmed_roi", f"""with {PICK}, r as (select *, row_number() over (order by back desc, race_id) as rn from st)
    select removed, round(sum(back) / sum(stake) - 1, 4) as roi from r cross join (select unnest([1, 5, 10]) as removed) where rn > removed group by 1""")  # fmt: skip
def k2b(t: Tables) -> DataFrame:
    return K.trimmed_roi(_settled_picks(t), "stake", "back", [1, 5, 10], ["race_id"])


@query("K4_calibration_quality", f"""with {P}, c as (select *, pow(p, 1.1) / sum(pow(p, 1.1)) over (partition by race_id) as q from pr)
    select count(*) filter (where finish_position = 1) as winners, round(sum(case when finish_position = 1 then -ln(greatest(p, 1e-12)) end) / count(*) filter (where finish_position = 1), 7) as p_log_loss, round(avg(pow(p - (finish_position = 1)::int, 2)), 8) as p_brier,
      round(sum(case when finish_position = 1 then -ln(greatest(q, 1e-12)) end) / count(*) filter (where finish_position = 1), 7) as q_log_loss, round(avg(pow(q - (finish_position = 1)::int, 2)), 8) as q_brier from c""")  # fmt: skip
def k4(t: Tables) -> DataFrame:
    c = M.devig(t.starts, ["race_id"], "win_odds").withColumn("q", M.power_calibrate("p", 1.1, ["race_id"]))
    out = K.calibration_quality(c, F.col("finish_position") == 1, ["p", "q"])
    return out.withColumns({c: F.round(c, 7 if "loss" in c else 8) for c in out.columns if c != "winners"})


def _rounded(t: Tables) -> DataFrame:
    """Probabilities, and as ``r`` rounded: one that is the edge of a bin is in the same bin whatever the order its race was summed in."""
    return M.devig(t.starts, ["race_id"], "win_odds").withColumn("r", F.round("p", 12))


@query("K5_calibration_bins", f"""with {P}, b as (select *, case when r > 0 and r <= 0.05 then 0 when r > 0.05 and r <= 0.1 then 1 when r > 0.1 and r <= 0.25 then 2 when r > 0.25 and r <= 1 then 3 end as bin from (select *, round(p, 12) as r from pr))
    select bin, count(*) as n, round(avg((finish_position = 1)::int), 8) as observed, count(*) < 100 as thin, round(avg(p), 8) as mean_p, round(avg(pow(p - (finish_position = 1)::int, 2)), 8) as brier_p from b where bin is not null group by 1""")  # fmt: skip
def k5(t: Tables) -> DataFrame:
    out = K.calibration_bins(_rounded(t), "r", ["p"], F.col("finish_position") == 1, [0, 0.05, 0.1, 0.25, 1.0], thin=100)
    return out.withColumns({c: F.round(c, 8) for c in ("observed", "mean_p", "brier_p")})


@query("K6_reliability_by_flag", f"""with {P}, b as (select pr.*, s.surface, case when r >= 0 and r < 0.1 then 0 when r >= 0.1 and r < 0.3 then 1 when r >= 0.3 and r <= 1 then 2 end as bin from (select *, round(p, 12) as r from pr) pr join starts s on pr.race_id = s.race_id and pr.runner = s.runner)
    select surface, bin, count(*) as n, round(avg((finish_position = 1)::int), 8) as observed, count(*) < 50 as thin, round(avg(p), 8) as mean_p, round(avg(pow(p - (finish_position = 1)::int, 2)), 8) as brier_p from b where bin is not null group by 1, 2""")  # fmt: skip
def k6(t: Tables) -> DataFrame:
    out = K.calibration_bins(_rounded(t), "r", ["p"], F.col("finish_position") == 1, [0, 0.1, 0.3, 1.0], closed="left", thin=50, group=["surface"])
    return out.withColumns({c: F.round(c, 8) for c in ("observed", "mean_p", "brier_p")})


@query("K7_takeout_sanity", f"with {P}, y as (select race_id, combo, max(payout_yen) as y from payouts group by 1, 2) select round(sum(coalesce(y, 0) / 100.0 * p) / sum(p) - 1, 6) as roi, count(*) as bets from pr left join y on y.race_id = pr.race_id and y.combo = lpad(cast(pr.runner as varchar), 2, '0')")
def k7(t: Tables) -> DataFrame:
    y = t.payouts.groupBy("race_id", "combo").agg(F.max("payout_yen").alias("y"))
    d = M.devig(t.starts, ["race_id"], "win_odds").withColumn("combo", F.lpad(F.col("runner").cast("string"), 2, "0")).join(y, ["race_id", "combo"], "left")
    return d.agg(F.round(F.sum(F.coalesce("y", F.lit(0)) / 100.0 * F.col("p")) / F.sum("p") - 1, 6).alias("roi"), F.count(F.lit(1)).alias("bets"))


@query("K8_roi_by_slice", f"select year(race_date) as y, case when win_odds < 10 then 'short' when win_odds < 30 then 'mid' else 'long' end as band, count(*) as n, case when count(*) >= 100 then round(sum(case when finish_position = 1 then win_odds else 0 end) / count(*) - 1, 7) end as roi from starts group by 1, 2")
def k8(t: Tables) -> DataFrame:
    band = F.when(F.col("win_odds") < 10, "short").when(F.col("win_odds") < 30, "mid").otherwise("long")
    n = F.count(F.lit(1))
    back = F.sum(F.when(F.col("finish_position") == 1, F.col("win_odds")).otherwise(0.0))
    return t.starts.groupBy(F.year("race_date").alias("y"), band.alias("band")).agg(n.alias("n"), F.when(n >= 100, F.round(back / n - 1, 7)).alias("roi"))


@query("K9_settlement_oracle", "select count(*) as rows_, 0::bigint as mismatches from payouts")
def k9(t: Tables) -> DataFrame:
    out = S.settle_bets(t.payouts.select("race_id", "pool", "combo", F.lit(100).alias("stake"), "payout_yen"), t.payouts, t.starts, t.starts)
    return out.agg(F.count(F.lit(1)).alias("rows_"), F.count_if(F.col("payout") != F.col("payout_yen")).alias("mismatches"))


@query("K10_era_split", "select race_id, year(race_date) as era, case when row_number() over (partition by year(race_date) order by race_date, race_id) <= greatest(1, floor(count(*) over (partition by year(race_date)) * 0.7)) then 'train' else 'test' end as split from (select distinct race_id, race_date from starts)")
def k10(t: Tables) -> DataFrame:
    return K.era_split(t.starts.select("race_id", "race_date").distinct(), F.year("race_date"), ["race_date", "race_id"]).select("race_id", "era", "split")


@query("K11_logit_probs")
def k11(t: Tables) -> DataFrame:
    d = t.starts.withColumn("y", (F.col("finish_position") == 1).cast("double")).withColumn("lo", F.ln("win_odds"))
    out = K.fit_logit_probs(d.where("year(race_date) % 2 = 0"), d, ["lo", "going_wetness"], "y", ["race_id"])
    return out.select("race_id", "runner", "model_prob")


@query("K19_conditional_logit")
def k19(t: Tables) -> DataFrame:
    names = ["log_odds", "going_wetness"]
    d = t.starts.withColumn("log_odds", F.ln("win_odds"))
    w = K.fit_conditional_logit(d, "race_id", names, F.col("finish_position") == 1)
    return t.spark.createDataFrame(list(zip(names, w, strict=True)), "feature string, weight double")


@query("K12_cluster_bootstrap", """
    with d as (select race_date, sum(case when finish_position = 1 then win_odds else 0 end) as a, count(*)::double as b from starts where race_date is not null group by 1),
         c as (select *, row_number() over (order by race_date) as i, count(*) over () as n from d),
         x as (select draw, ('0x' || substr(md5('0-' || draw || '-' || i), 1, 15))::bigint % n + 1 as pick from c, range(1, 501) r(draw)),
         m as (select sum(a) / sum(b) as m from x join c on c.i = pick group by draw)
    select (select round(sum(a) / sum(b), 9) from c) as point, round(quantile_cont(m, 0.025), 9) as lo, round(quantile_cont(m, 0.975), 9) as hi from m""")
def k12(t: Tables) -> DataFrame:
    d = t.starts.withColumn("back", F.when(F.col("finish_position") == 1, F.col("win_odds")).otherwise(0.0)).withColumn("one", F.lit(1.0))
    return K.cluster_bootstrap(d, "race_date", "back", "one", K.DRAWS).select(*[F.round(c, 9).alias(c) for c in ("point", "lo", "hi")])


@query("K13_disagreement", f"""with {P}, m as (select pr.*, s.win_odds, 1.0 / count(*) over (partition by pr.race_id) / p as ratio from pr join starts s on pr.race_id = s.race_id and pr.runner = s.runner), c as (select quantile_cont(ratio, 0.75) as cut from m)
    select case when win_odds < 20 then 'short' else 'long' end as band, count(*) as n, round(avg((finish_position = 1)::int), 8) as hit, round(sum(case when finish_position = 1 then win_odds else 0 end) / count(*) - 1, 7) as roi from m, c where ratio >= cut group by 1""")  # fmt: skip
def k13(t: Tables) -> DataFrame:
    w = Window.partitionBy("race_id")
    m = M.devig(t.starts, ["race_id"], "win_odds").withColumn("ratio", 1.0 / F.count(F.lit(1)).over(w) / F.col("p"))
    cut = m.agg(F.percentile("ratio", F.lit(0.75)).alias("cut"))
    n = F.count(F.lit(1))
    back = F.sum(F.when(F.col("finish_position") == 1, F.col("win_odds")).otherwise(0.0))
    top = m.join(F.broadcast(cut), m["ratio"] >= cut["cut"])
    return top.groupBy(F.when(F.col("win_odds") < 20, "short").otherwise("long").alias("band")).agg(n.alias("n"), F.round(F.avg((F.col("finish_position") == 1).cast("double")), 8).alias("hit"), F.round(back / n - 1, 7).alias("roi"))


@query("K20_blend_grid", f"""with {P}, g as (select unnest([0.0, 0.5, 1.0])::double as a), x as (select pr.race_id, finish_position, a, a * greatest(-10, least(10, ln(greatest(p, 1e-300) / greatest(1 - p, 1e-300)))) as z from pr cross join g),
    m as (select race_id, a, ln(sum(exp(z))) as lse, max(case when finish_position = 1 then z end) as x from x group by 1, 2)
    select a as w0, round(sum(lse - x), 4) as nll, count(*) as races from m where x is not null group by 1""")  # fmt: skip
def k20(t: Tables) -> DataFrame:
    d = M.devig(t.starts, ["race_id"], "win_odds").withColumn("lg", X.logit(F.col("p")))
    return K.blend_losses(d, "race_id", ["lg"], F.col("finish_position") == 1, [[0.0], [0.5], [1.0]]).withColumn("nll", F.round("nll", 4))


@query("K20_blend_grid_whole")
def k20_whole(t: Tables) -> DataFrame:
    d = M.devig(t.starts, ["race_id"], "win_odds").withColumn("lg", X.logit(F.col("p")))
    return K.blend_losses(d, "race_id", ["lg"], F.col("finish_position") == 1, [[w] for w in K.BLENDS]).withColumn("nll", F.round("nll", 4))


@query("K21_bootstrap_blend")
def k21(t: Tables) -> DataFrame:
    d = M.devig(t.starts, ["race_id"], "win_odds").withColumn("lg", X.logit(F.col("p")))
    per = K.blend_losses(d, "race_id", ["lg"], F.col("finish_position") == 1, [[w] for w in K.BLENDS], group=["race_date"])
    return K.bootstrap_blend(per, "race_date", K.BLENDS, K.DRAWS)


@query("K22_edge_roi", f"""with {P}, e as (select pr.*, s.win_odds, pow(p, 0.9) * win_odds as edge, c from pr join starts s on pr.race_id = s.race_id and pr.runner = s.runner cross join (select unnest([0.0, 0.1])::double as c)),
    f as (select *, row_number() over (partition by race_id, c order by edge desc, runner) as rn from e where edge >= 1.0 / (1.0 - c))
    select c as capacity, d as removed, count(*) as bets, round(sum(case when finish_position = 1 then win_odds * (1 - c) else 0 end), 5) as returned, round(sum(case when finish_position = 1 then win_odds * (1 - c) else 0 end) / count(*) - 1, 8) as roi
    from f cross join (select unnest([0, 1]) as d) where rn > d group by 1, 2""")  # fmt: skip
def k22(t: Tables) -> DataFrame:
    d = M.devig(t.starts, ["race_id"], "win_odds").withColumn("q", F.pow("p", F.lit(0.9)))
    out = K.edge_roi(d, "race_id", "runner", "q", "win_odds", F.col("finish_position") == 1, [0.0, 0.1], [0, 1])
    return out.withColumns({"returned": F.round("returned", 5), "roi": F.round("roi", 8)})


@query("K24_market_prior", f"with {P} select race_id, runner, round(log10(coalesce(case when runner <> 2 then p end, 1.0::double / count(*) over (partition by race_id))), 8) as l from pr")
def k24(t: Tables) -> DataFrame:
    d = M.devig(t.starts, ["race_id"], "win_odds")
    prior = F.coalesce(F.when(F.col("runner") != 2, F.col("p")), 1.0 / F.count(F.lit(1)).over(Window.partitionBy("race_id")))
    return d.select("race_id", "runner", F.round(F.log10(prior), 8).alias("l"))


