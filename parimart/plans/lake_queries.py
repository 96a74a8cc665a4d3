"""Queries over sections: sources and sinks (A), normalisation (B), marts (I), streams (L) and social tables (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import marts as A
from ..operators import market as M
from ..operators import relational as R
from ..operators import social as N
from ..sources import lake as L
from ..streaming import ingest as T
from .bindings import Tables
from .market_queries import P
from .registry import query
from .relational_queries import TOP3, WIN


@query("A5_merge_by_hash", "select l_orderkey, bool_and(is_new) as is_new from (select distinct l_orderkey, false as is_new from lineitem where l_returnflag = 'A' union all select distinct l_orderkey, true from lineitem where l_returnflag = 'R' and l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')) group by 1")
def a5(t: Tables) -> DataFrame:
    k = t.lineitem.select("l_orderkey", "l_returnflag")
    return L.merge_by_hash(k.where("l_returnflag = 'R'").select("l_orderkey"), k.where("l_returnflag = 'A'").select("l_orderkey").distinct(), "l_orderkey")


@query("A7_explode_slots", "select p_partkey, i + 1 as slot, lpad(cast((p_partkey + i) % 100 as varchar), 2, '0') as sel from part cross join (select unnest([0, 1, 2, 3]) as i) where (p_partkey + i) % 3 <> 0")
def a7(t: Tables) -> DataFrame:
    slot = lambda i: F.when((F.col("p_partkey") + i) % 3 != 0, F.lpad(((F.col("p_partkey") + i) % 100).cast("string"), 2, "0")).otherwise("  ")
    rec = t.part.select("p_partkey", F.concat(F.lit("HD"), *[slot(i) for i in range(4)]).alias("rec"))
    return L.explode_slots(rec, "rec", 3, 2, 4, [("sel", 1, 2)])


@query("A8_flatten_odds_json", "select event_id, sel, case when sel <> '03' then value + cast(sel as int) end as win_odds, case when sel <> '03' then cast(user_id as int) end as popularity, case when sel <> '01' then 1.5 end::double as place_low, case when sel <> '01' then 2.5 end::double as place_high from events cross join (select unnest(['01', '02', '03']) as sel)")
def a8(t: Tables) -> DataFrame:
    win = lambda s: F.concat(F.lit(f'"{s}":["'), (F.col("value") + int(s)).cast("string"), F.lit('","","'), F.col("user_id").cast("string"), F.lit('"]'))
    body = F.concat(F.lit('{"status":"ok","data":{"official_datetime":null,"odds":{"1":{'), win("01"), F.lit(","), win("02"), F.lit('},"2":{"02":["1.5","2.5","1"],"03":["1.5","2.5","1"]}}}}'))
    return L.flatten_odds(t.events.select("event_id", "ts", body.alias("payload")), "payload", "ts").select("event_id", "sel", "win_odds", "popularity", "place_low", "place_high")


@query("A9_flatten_combo_json", "select event_id, 'b' || (event_id % 3) as block, lpad(cast(user_id % 18 + 1 as varchar), 2, '0') || '02' as combo, value as odds, cast(user_id as int) as popularity from events")
def a9(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"b'), (F.col("event_id") % 3).cast("string"), F.lit('":{"'), F.lpad((F.col("user_id") % 18 + 1).cast("string"), 2, "0"), F.lit('02":["'), F.col("value").cast("string"), F.lit('","x","'), F.col("user_id").cast("string"), F.lit('"]}}'))
    return L.flatten_combo_odds(t.events.select("event_id", body.alias("payload")), "payload")


@query("A10_extract_html", """
    select page_id, i - 1 as pos, nullif(regexp_extract(r, 'href="([^"]*)"', 1), '') as href from (select page_id, r, i from
      (select page_id, regexp_extract_all(html, '<a [^>]*>') as rs from pages), unnest(rs) with ordinality as u(r, i))""")  # fmt: skip
def a10(t: Tables) -> DataFrame:
    return L.extract_rows(t.pages.select("page_id", "html"), "html", "<a [^>]*>", {"href": 'href="([^"]*)"'}).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query("A13_append_dedupe", "with n as (select *, row_number() over (partition by race_id, runner, available_at order by win_odds) as rn from odds_ts where runner % 2 = 0 or pool = 'click') select race_id, runner, available_at, win_odds from n where rn = 1 and not exists (select 1 from odds_ts o where o.pool = 'click' and o.race_id = n.race_id and o.runner = n.runner and o.available_at = n.available_at)")
def a13(t: Tables) -> DataFrame:
    k = ["race_id", "runner", "available_at"]
    return L.append_new(t.odds_ts.where("runner % 2 = 0 or pool = 'click'"), t.odds_ts.where("pool = 'click'"), k, ["win_odds"]).select(*k, "win_odds")


@query("A14_partition_upsert", "select race_id, runner, v from (select *, row_number() over (partition by race_id, runner order by n desc, v desc) as rn from (select race_id, runner, win_odds as v, 0 as n from starts union all select race_id, runner, win_odds + 100, 1 from starts where runner = 2)) where rn = 1")
def a14(t: Tables) -> DataFrame:
    s = t.starts.select("race_id", "runner", F.col("win_odds").alias("v"))
    return L.last_write_wins(s, s.where("runner = 2").withColumn("v", F.col("v") + 100), ["race_id", "runner"], "v")


@query("A15_upsert_on_key", "select race_id, runner, win_odds from starts where race_id % 7 <> 0 union all select race_id, runner, 1.0::double from starts where race_id % 7 = 0 and runner = 1 union all select race_id, runner, win_odds from starts s where race_id % 7 = 0 and not exists (select 1 from starts x where x.race_id = s.race_id and x.runner = 1)")
def a15(t: Tables) -> DataFrame:
    s = t.starts.select("race_id", "runner", "win_odds")
    return L.upsert_on_key(s, s.where("race_id % 7 = 0 and runner = 1").withColumn("win_odds", F.lit(1.0)), ["race_id"])


@query("A16_append_versioned", "with e as (select o_custkey, max(o_orderkey % 4) as v from orders where o_orderstatus = 'F' group by 1) select o.o_orderkey, o.o_custkey, coalesce(v, 0) + 1 as version from orders o left join e on o.o_custkey = e.o_custkey where o_orderstatus = 'P'")
def a16(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderkey") % 4).alias("version"))
    return L.append_versioned(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'").drop("version"), ["o_custkey"]).select("o_orderkey", "o_custkey", "version")


@query("A18_hash_gated_upsert", "select race_id, runner from starts where runner % 3 = 0 or (runner % 3 = 1 and win_odds > 30)")
def a18(t: Tables) -> DataFrame:
    s = t.starts.select("race_id", "runner", "win_odds", F.least("win_odds", F.lit(30.0)).cast("string").alias("h"))
    new = s.withColumn("h", F.col("win_odds").cast("string"))
    return L.hash_gated(new, s.where("runner % 3 <> 0").withColumn("h", F.when(F.col("runner") % 3 == 2, F.col("win_odds").cast("string")).otherwise(F.col("h"))), ["race_id", "runner"], "h").select("race_id", "runner")


@query("A19_conditional_upsert", "select ticket_id, case when ticket_id % 5 = 0 then 'inserted' when ticket_id % 7 = 0 then 'conflict' when state <> 'open' then 'closed' else 'updated' end as outcome from tickets")
def a19(t: Tables) -> DataFrame:
    new = t.tickets.withColumn("user_id", F.when(F.col("ticket_id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return L.conditional_upsert(t.tickets.where("ticket_id % 5 <> 0"), new, "ticket_id", "user_id", "state").select("ticket_id", "outcome")


@query("A20_lww_merge", "select race_id, runner, max(available_at) as available_at, arg_max(src, (available_at, src = 'local')) as src from (select race_id, runner, available_at, 'local' as src from odds_ts where pool <> 'view' union all select race_id, runner, available_at, 'server' from odds_ts where runner % 2 = 0) group by 1, 2")
def a20(t: Tables) -> DataFrame:
    o = t.odds_ts.select("race_id", "runner", "available_at", "pool")
    a, b = o.where("pool <> 'view'").drop("pool").withColumn("src", F.lit("local")), o.where("runner % 2 = 0").drop("pool").withColumn("src", F.lit("server"))
    return L.lww_merge(a, b, ["race_id", "runner"], "available_at", ["src"])


@query("A21_replace_user_rows", "select user_id, ticket_id from tickets where user_id % 2 = 1 union all select user_id, ticket_id from (select *, row_number() over (partition by user_id order by ticket_id) as rn from tickets where user_id % 2 = 0 and cost >= 300) where rn <= 20")
def a21(t: Tables) -> DataFrame:
    k = t.tickets.select("user_id", "ticket_id", "cost")
    return L.replace_user_rows(k, k.where("user_id % 2 = 0"), "user_id", F.col("cost") >= 300, 20, ["ticket_id"]).select("user_id", "ticket_id")


@query("A22_publish_rows", "select s.race_id, s.runner, strftime(race_date, '%Y-%m-%dT%H:%M:%SZ') as race_date, cast(finish_position = 1 as int) as won, c_name from starts s left join customer c on c_custkey = trainer_id")
def a22(t: Tables) -> DataFrame:
    rows = t.starts.withColumn("won", F.col("finish_position") == 1).join(t.customer.select(F.col("c_custkey").alias("trainer_id"), "c_name"), "trainer_id", "left")
    return A.publish_rows(rows, ["won"], ["race_date"]).select("race_id", "runner", "race_date", "won", "c_name")


@query("A23_validate_tickets", "select event_id, case when event_id % 6 = 0 then 'type' when event_id % 6 = 1 then 'combo' when event_id % 6 = 2 then 'cost' when event_id % 6 = 3 then 'race' end as reject from events")
def a23(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    kind, combo = F.when(k == 0, "yonrenpuku").otherwise("exacta"), F.when(k == 1, '["3","3"]').otherwise('["3","8"]')
    body = F.concat(F.lit('{"ticket":{"type":"'), kind, F.lit('","lines":[{"combo":'), combo, F.lit('}]},"unit":100,"cost":'), F.when(k == 2, "300").otherwise("100"), F.lit(',"race":{"raceKey":"'), F.when(k == 3, "x").otherwise("20240101-05-11"), F.lit('"}}'))
    return L.validate_tickets(t.events.select("event_id", body.alias("payload")), "payload", {"exacta": 2, "trio": 3}).select("event_id", "reject")


@query("B1_build_races", "select o_orderkey, case o_orderstatus when 'F' then 'turf' when 'O' then 'dirt' end as surface, o_orderdate + interval '6 hours' as post_utc from (select *, row_number() over (partition by o_orderkey order by o_orderdate desc) as rn from orders) where rn = 1")
def b1(t: Tables) -> DataFrame:
    from ..functions.scalars import jst_to_utc, labelled

    o = R.dedupe_latest(t.orders, ["o_orderkey"], "o_orderdate")
    return o.select("o_orderkey", labelled(F.col("o_orderstatus"), {"F": "turf", "O": "dirt"}).alias("surface"), jst_to_utc(F.col("o_orderdate"), F.lit("1500")).alias("post_utc"))


@query("B2_entries_results", "select race_id, runner, nullif(going_wetness, 4) as weight, nullif(finish_position, 7) as finish_position from starts")
def b2(t: Tables) -> DataFrame:
    return t.starts.select("race_id", "runner", F.nullif("going_wetness", F.lit(4)).alias("weight"), F.nullif("finish_position", F.lit(7)).alias("finish_position"))


@query("B3_event_time", "select race_id, runner, coalesce(case when runner % 2 = 0 then available_at end, race_date) as at from starts")
def b3(t: Tables) -> DataFrame:
    return t.starts.select("race_id", "runner", F.coalesce(F.when(F.col("runner") % 2 == 0, F.col("available_at")), F.col("race_date")).alias("at"))


@query("B4_unpivot_odds", "select l_orderkey, l_linenumber, kind, v from (select l_orderkey, l_linenumber, 'win' as kind, l_quantity as v from lineitem union all select l_orderkey, l_linenumber, 'place', l_discount from lineitem) where v > 0.02")
def b4(t: Tables) -> DataFrame:
    x = F.explode(F.array(F.struct(F.lit("win").alias("kind"), F.col("l_quantity").alias("v")), F.struct(F.lit("place").alias("kind"), F.col("l_discount").alias("v"))))
    return t.lineitem.select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.kind", "x.v").where("v > 0.02")


@query("B5_odds_timeseries", "select race_id, runner, available_at, win_odds, cast(split_part(race_id, '-', 2) as int) as year from (select *, row_number() over (partition by race_id, runner, available_at order by src desc, win_odds desc) as rn from (select race_id, runner, available_at, win_odds, 1 as src from odds_ts union all select race_id, runner, available_at, win_odds + 1, 2 from odds_ts where runner = 3)) where rn = 1")
def b5(t: Tables) -> DataFrame:
    o = t.odds_ts.select("race_id", "runner", "available_at", "win_odds")
    both = o.withColumn("src", F.lit(1)).unionByName(o.where("runner = 3").withColumn("win_odds", F.col("win_odds") + 1).withColumn("src", F.lit(2)))
    one = R.top_k(both, ["race_id", "runner", "available_at"], [F.desc("src"), F.desc("win_odds")], 1)
    return one.select("race_id", "runner", "available_at", "win_odds", F.split("race_id", "-")[1].cast("int").alias("year"))


@query("B6_build_payouts", "select race_id, pool, combo, payout_yen from payouts where payout_yen is not null")
def b6(t: Tables) -> DataFrame:
    return t.payouts.where("payout_yen is not null").select("race_id", "pool", "combo", "payout_yen")


@query("B7_union_models", "select race_id, runner, 'time' as model, finish_time_seconds as a, cast(null as double) as b from starts union all select race_id, runner, 'odds', null, win_odds from starts")
def b7(t: Tables) -> DataFrame:
    s = t.starts
    a = s.select("race_id", "runner", F.lit("time").alias("model"), F.col("finish_time_seconds").alias("a"))
    return a.unionByName(s.select("race_id", "runner", F.lit("odds").alias("model"), F.col("win_odds").alias("b")), allowMissingColumns=True)


@query("B9_build_master", "select c_custkey, n from (select *, row_number() over (partition by c_custkey order by v desc) as rn from (select c_custkey, regexp_replace(trim(c_name), '\\s+', ' ', 'g') as n, 1 as v, false as gone from customer union all select c_custkey, c_name || '!', 2, c_custkey % 2 = 0 from customer) where not gone) where rn = 1")
def b9(t: Tables) -> DataFrame:
    c = t.customer
    rows = c.select("c_custkey", F.regexp_replace(F.trim("c_name"), "\\s+", " ").alias("n"), F.lit(1).alias("v"), F.lit(False).alias("gone")).unionByName(
        c.select("c_custkey", F.concat("c_name", F.lit("!")).alias("n"), F.lit(2).alias("v"), (F.col("c_custkey") % 2 == 0).alias("gone"))
    )
    return R.dedupe_latest(rows.where("not gone"), ["c_custkey"], "v").select("c_custkey", "n")


@query("B10_build_votes", "select race_id, combo, payout_yen * 100 as yen from payouts where right(combo, 1) <> '3'")
def b10(t: Tables) -> DataFrame:
    return R.dedupe_latest(t.payouts, ["race_id", "pool", "combo"], "available_at").where(~F.col("combo").endswith("3")).select("race_id", "combo", (F.col("payout_yen") * 100).alias("yen"))


@query("B11_declarations", "select l_orderkey, l_linenumber, l_returnflag in ('R', 'A') as is_excluded, case l_returnflag when 'R' then 'scratched' when 'A' then 'excluded' end as exclusion_kind from lineitem")
def b11(t: Tables) -> DataFrame:
    from ..functions.scalars import labelled

    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").isin("R", "A").alias("is_excluded"), labelled(F.col("l_returnflag"), {"R": "scratched", "A": "excluded"}).alias("exclusion_kind"))


@query("B16_select_card", "select o_orderkey, o_orderdate from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'F' order by o_orderdate nulls last, o_orderkey")
def b16(t: Tables) -> DataFrame:
    return A.select_card(t.orders, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") == "F", time="o_orderdate", key="o_orderkey").select("o_orderkey", "o_orderdate")


@query("B17_upcoming", "select o_orderkey, o_orderdate, r as rank from (select *, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 end as r from orders where o_orderdate >= timestamp '1997-01-01') where r is not null order by r, o_orderdate, o_orderkey limit 50")
def b17(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2)
    return A.ranked_upcoming(t.orders, "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"), rank, "o_orderkey", 50).select("o_orderkey", "o_orderdate", "rank")


@query("B19_numeric_items", "select race_id, runner, win_odds from odds_ts where pool = 'click'")
def b19(t: Tables) -> DataFrame:
    s = t.odds_ts.where("pool = 'click'").withColumn("sel", F.lpad(F.col("runner").cast("string"), 2, "0"))
    return s.withColumn("runner", F.col("sel").try_cast("int")).where("runner is not null").select("race_id", "runner", "win_odds")


@query("I1_races_mart", "select race_id, race_date, surface, count(*) as field_size, bool_or(finish_position is not null) as has_results from starts group by 1, 2, 3")
def i1(t: Tables) -> DataFrame:
    return A.races_mart(t.starts, "race_id", ["race_date", "surface"], "finish_position")


@query("I2_entries_mart", f"with {P} select s.race_id, s.runner, s.horse_id, s.finish_position, round(p, 9) as p from starts s left join pr on s.race_id = pr.race_id and s.runner = pr.runner")
def i2(t: Tables) -> DataFrame:
    d = M.devig(t.starts, ["race_id"], "win_odds").select("race_id", "runner", F.round("p", 9).alias("p"))
    return t.starts.select("race_id", "runner", "horse_id", "finish_position").join(d, ["race_id", "runner"], "left")


@query("I4_horse_card", f"""
    with h as (select * from starts where available_at < timestamp '1996-01-01'), c as (select horse_id, count(*) as starts, {WIN} as wins, {TOP3} as top3 from h group by 1),
    r as (select horse_id, string_agg(cast(finish_position as varchar), ',' order by race_date desc, race_id, runner) as recent from (select *, row_number() over (partition by horse_id order by race_date desc, race_id, runner) as rn from h) where rn <= 8 group by 1),
    s as (select horse_id, count(distinct surface) as surfaces, sum(case when surface = 'F' then 1 else 0 end) as f_starts from h group by 1)
    select c.horse_id, starts, wins, top3, recent, surfaces, f_starts from c join r on c.horse_id = r.horse_id join s on c.horse_id = s.horse_id""")  # fmt: skip
def i4(t: Tables) -> DataFrame:
    card = A.form_card(t.starts, "horse_id", F.lit("1996-01-01").cast("timestamp_ntz"), "available_at", [F.desc("race_date"), "race_id", "runner"], "finish_position", ["surface"])
    return card.select(
        "horse_id", "career.starts", "career.wins", "career.top3", F.array_join(F.transform("recent", lambda z: z["finish_position"].cast("string")), ",").alias("recent"),
        F.size("by_surface").cast("long").alias("surfaces"), F.coalesce(F.try_element_at("by_surface", F.lit("F"))["starts"], F.lit(0)).alias("f_starts"),
    )


@query("I5_jockey_card", f"with h as (select * from starts where available_at < timestamp '1997-01-01') select jockey_id, count(*) as starts, {WIN} as wins, count(distinct racecourse) as courses from h group by 1")
def i5(t: Tables) -> DataFrame:
    card = A.form_card(t.starts, "jockey_id", F.lit("1997-01-01").cast("timestamp_ntz"), "available_at", [F.desc("race_date"), "race_id", "runner"], "finish_position", ["racecourse"], 10, ["win_odds"])
    return card.select("jockey_id", "career.starts", "career.wins", F.size("by_racecourse").cast("long").alias("courses"))


@query("I6_race_form", f"""with h as (select horse_id, available_at, count(*) as n, {WIN} as w from starts group by 1, 2), q as (select distinct race_id, horse_id, race_date from starts),
    f as (select q.horse_id, q.race_date, sum(n) as n, sum(w) as w from (select distinct horse_id, race_date from q) q join h on q.horse_id = h.horse_id and h.available_at < q.race_date group by 1, 2)
    select q.race_id, q.horse_id, f.n as starts, f.w as wins, case when f.n is null then 'no_history' else 'ok' end as status from q left join f on q.horse_id = f.horse_id and q.race_date = f.race_date""")  # fmt: skip
def i6(t: Tables) -> DataFrame:
    return A.card_for_races(t.starts, t.starts, "horse_id", "race_id", "race_date", "available_at", "finish_position").select("race_id", "horse_id", "starts", "wins", "status")


@query("I7_live_snapshot", "select race_id, count(*) as n, case when bool_or(race_id % 2 = 0 and finish_position = 1) then 'result' when bool_or(runner % 2 = 1) then 'open' else 'registered' end as status from starts group by 1")
def i7(t: Tables) -> DataFrame:
    out = A.live_snapshot(t.starts, t.starts.where("runner % 2 = 1"), t.starts.where("race_id % 2 = 0 and finish_position = 1"), "race_id", "runner")
    return out.select("race_id", "n", "status")


@query("I9_latest_edition", "select ticket_id from tickets where cast(created_at as date) = (select max(cast(created_at as date)) from tickets)")
def i9(t: Tables) -> DataFrame:
    return A.latest_edition(t.tickets.withColumn("day", F.col("created_at").cast("date")), "day").select("ticket_id")


@query("I10_market_shape", f"with {P}, r as (select *, row_number() over (partition by race_id order by round(p, 12) desc, runner) as rk from pr), s as (select race_id, max(p) as favourite, sum(p) as top3 from r where rk <= 3 group by 1) select race_id, round(favourite, 9) as favourite, round(top3, 8) as top3, case when round(favourite, 12) >= 0.4 then 'dominant' when round(top3, 12) >= 0.65 then 'concentrated' else 'open' end as shape from s")
def i10(t: Tables) -> DataFrame:
    return A.market_shape(M.devig(t.starts, ["race_id"], "win_odds"), "race_id", "p", "runner").withColumns({"favourite": F.round("favourite", 9), "top3": F.round("top3", 8)})


@query("I11_pace_map", "select race_id, sum((going_wetness = 1)::int) as front, sum((going_wetness = 4)::int) as closers, case when sum((going_wetness = 1)::int) >= 3 then 'fast' when sum((going_wetness = 1)::int) = 0 then 'slow' else 'even' end as pace from starts group by 1")
def i11(t: Tables) -> DataFrame:
    return A.counted_class(t.starts.withColumn("style", F.col("going_wetness").cast("string")), "race_id", "style", ["1"], ["4"])


@query("I12_contender_groups", "select race_id, runner, tier, place from (select race_id, runner, tier, row_number() over (partition by race_id, tier order by win_odds, runner) as place from (select *, case when win_odds <= 6 then 'core' when win_odds <= 20 then 'challenger' else 'outsider' end as tier from starts)) where place <= case tier when 'outsider' then 4 else 5 end")
def i12(t: Tables) -> DataFrame:
    return A.contender_groups(t.starts, "race_id", "runner", "win_odds").select("race_id", "runner", "tier", "place")


@query("I13_trend_counts", "select tag, count(*) as n from (select surface as tag from starts union all select racecourse from starts) group by 1")
def i13(t: Tables) -> DataFrame:
    return t.starts.select(F.explode(F.array("surface", "racecourse")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("I14_ticket_lens", "select arg_max(race_id, (m, -race_id)) as longest, arg_max(race_id, (n, -race_id)) as largest, arg_max(race_id, (-m, -race_id)) as shortest from (select race_id, max(win_odds) as m, count(*) as n from starts group by 1)")
def i14(t: Tables) -> DataFrame:
    by = t.starts.groupBy("race_id").agg(F.max("win_odds").alias("m"), F.count(F.lit(1)).alias("n"))
    return A.argmax_picks(by, {"longest": F.col("m"), "largest": F.col("n"), "shortest": -F.col("m")}, "race_id")


@query("I17_nested_cards", "select race_id, count(*) as n, string_agg(cast(runner as varchar), ',' order by runner) as runners from starts group by 1")
def i17(t: Tables) -> DataFrame:
    out = A.nested_by(t.starts, ["race_id"], ["runner"], ["win_odds", "finish_position"], "rows")
    return out.select("race_id", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda z: z["runner"].cast("string")), ",").alias("runners"))


@query("G12_freeze_model_card", "select race_id, runner, round(case when sum(case when s > 0 then s end) over w > 0 then greatest(s, 0) / sum(case when s > 0 then s end) over w else 1.0 / count(*) over w end, 9) as model_prob, race_id % 3 = 0 or race_date < first as pre_market from (select st.*, win_odds - 5 as s, min(available_at) over (partition by race_id) as first from starts st) window w as (partition by race_id)")
def g12(t: Tables) -> DataFrame:
    s = t.starts.withColumn("s", F.col("win_odds") - 5)
    out = A.freeze_model_card(s, "race_id", "runner", "s", t.starts.where("race_id % 3 <> 0"), "available_at", "race_date")
    return out.select("race_id", "runner", F.round("model_prob", 9).alias("model_prob"), "pre_market")


@query("L2_change_detection", "select event_id, user_id from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from (select event_id, user_id, ts, event_type from events)) where b is null or b <> event_type")
def l2(t: Tables) -> DataFrame:
    e = t.events.withColumn("at", F.struct("ts", "event_id"))
    return T.changed(e, ["user_id"], "at", "event_type").select("event_id", "user_id")


@query("L5_live_track", "select race_id, runner, arg_max(win_odds, available_at) as now, arg_min(win_odds, available_at) as opening from odds_ts group by 1, 2")
def l5(t: Tables) -> DataFrame:
    return T.track(t.odds_ts, ["race_id"], "runner", "available_at", "win_odds").select("race_id", "runner", "now", "opening")


@query("L6_watchdog_replay", """with c as (select date_trunc('hour', ts) as h, count(*) filter (event_type = 'error') >= 3 as failed from events group by 1),
    g as (select *, sum(case when failed then 0 else 1 end) over (order by h) as g from c), s as (select *, sum(failed::int) over (partition by g order by h) as n from g),
    m as (select *, min(case when n >= 2 then h end) over (partition by g) as start from s),
    d as (select *, case when n >= 2 then floor((epoch(h) - epoch(start)) / 900) end as step from m),
    b as (select *, lag(step) over (partition by g order by h) as before, lag(step) over (order by h) as had from d),
    a as (select h as "at", case when step is not null and step is distinct from before then 'failing' when not failed and had is not null then 'recovered' end as alert from b)
    select "at", alert from a where alert is not null""")
def l6(t: Tables) -> DataFrame:
    by = t.events.groupBy(F.date_trunc("hour", "ts").alias("at")).agg((F.count_if(F.col("event_type") == "error") >= 3).alias("failed"))
    return T.watchdog(by, "at", "failed", least=2)


@query("L7_rate_count", "select user_id, event_type, date_trunc('hour', ts) as bucket, count(*) as n, count(*) > 1 as limited from events group by 1, 2, 3")
def l7(t: Tables) -> DataFrame:
    return N.rate_count(t.events, "user_id", "event_type", "ts", 3600, 1)


@query("N1_mutual_friends", "select distinct a.source_id, a.target_id from edges a join edges b on a.source_id = b.target_id and a.target_id = b.source_id where a.state = 'accepted' and b.state = 'accepted'")
def n1(t: Tables) -> DataFrame:
    return N.mutual_friends(t.edges)


REL = "o as (select source_id, target_id, bool_or(state = 'accepted') as ok from edges group by 1, 2)"


@query("N2_friendship_state", f"""with {REL} select coalesce(a.source_id, b.target_id) as source_id, coalesce(a.target_id, b.source_id) as target_id,
    case when a.ok and b.ok then 'friends' when a.ok is null then 'pending_in' when b.ok is null then 'pending_out' else 'one_sided' end as relation from o a full join o b on a.source_id = b.target_id and a.target_id = b.source_id""")  # fmt: skip
def n2(t: Tables) -> DataFrame:
    return N.friendship_state(t.edges)


FR = "fr as (select distinct a.source_id, a.target_id from edges a join edges b on a.source_id = b.target_id and a.target_id = b.source_id where a.state = 'accepted' and b.state = 'accepted')"


@query("N3_share_feed", f"""with {FR}, v as (select user_id as viewer, user_id as owner from tickets union select fr.source_id, fr.target_id from fr where fr.source_id in (select user_id from tickets)),
    x as (select v.viewer, t.ticket_id, v.viewer = v.owner as mine, row_number() over (partition by v.viewer order by t.created_at desc, t.ticket_id desc) as place from v join tickets t on t.user_id = v.owner where not exists (select 1 from edges b where b.state = 'pending' and b.source_id = v.viewer and b.target_id = v.owner))
    select viewer, ticket_id, mine, place from x where place <= 100""")  # fmt: skip
def n3(t: Tables) -> DataFrame:
    viewers = t.tickets.select("user_id").distinct()
    return N.share_feed(t.tickets, N.mutual_friends(t.edges), t.edges.where("state = 'pending'"), viewers).select("viewer", "ticket_id", "mine", "place")


@query("N4_friends_on_card", f"with {FR}, x as (select distinct fr.source_id as viewer, state, user_id from fr join tickets on user_id = fr.target_id) select viewer, state, count(*) as friends from x group by 1, 2")
def n4(t: Tables) -> DataFrame:
    return N.friends_on(t.tickets, N.mutual_friends(t.edges), "state").select("viewer", "state", "friends")


@query("N5_profile_feed", "select user_id, ticket_id, place from (select *, row_number() over (partition by user_id order by created_at desc, ticket_id desc) as place from tickets) where place <= 50")
def n5(t: Tables) -> DataFrame:
    return R.top_k(t.tickets, ["user_id"], [F.desc("created_at"), F.desc("ticket_id")], 50, "place").select("user_id", "ticket_id", "place")


@query("N6_user_search", "select c_custkey, c_name from customer where lower(c_name) like 'customer#0000001%' and c_custkey % 9 <> 0 order by lower(c_name) <> 'customer#0000001', lower(c_name), c_custkey limit 20")
def n6(t: Tables) -> DataFrame:
    return N.user_search(t.customer, "c_name", "Customer#0000001", t.customer.where("c_custkey % 9 = 0").select("c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("N7_notifications", "select e.user_id, event_id, c_name, unread from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) filter (where event_type <> 'view') over (partition by user_id) as unread from events) e left join customer on c_custkey = event_id % 100 where rn <= 50")
def n7(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.col("ts").alias("created_at"), (F.col("event_type") == "view").alias("read"), (F.col("event_id") % 100).alias("actor"))
    return N.notification_list(rows, t.customer.select(F.col("c_custkey").alias("actor"), "c_name"), "user_id", "actor").select("user_id", "event_id", "c_name", "unread")


@query("N8_promote_wins", f"with {FR} select ticket_id, fr.target_id as recipient from tickets t join fr on fr.source_id = t.user_id where state = 'won' and (ticket_id + fr.target_id) % 4 <> 0")
def n8(t: Tables) -> DataFrame:
    f = N.mutual_friends(t.edges)
    told = t.tickets.select("ticket_id", F.col("user_id").alias("source_id")).join(f, "source_id").where("(ticket_id + target_id) % 4 = 0").select("ticket_id", F.col("target_id").alias("recipient"))
    return N.promote_wins(t.tickets, f, told)


