"""Queries that write files, tables or streams from the driver tables and read them back, and those of small functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compose as C
from ..operators import features as V
from ..operators import marts as A
from ..operators import settlement as G
from ..session import scratch, stored
from ..sources import lake as L
from ..streaming import ingest as T
from .bindings import Tables
from .registry import query


@query("A1_read_csv", "select o_orderkey, nullif(o_orderstatus, 'O') as o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as o_orderdate from orders")
def a1(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    status = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus"))
    t.orders.select("o_orderkey", status.alias("o_orderstatus"), "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("o_orderdate")).write.option("header", True).csv(path)
    rows = L.read_csv(t.spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp", ["o_orderdate"])
    return rows.withColumn("o_orderdate", S.iso_utc(F.col("o_orderdate")))


@query("A2_load_odds_csv", "select event_id, 1 + value as win_odds, strftime(case when event_id % 2 = 0 then ts - interval 1 hour else ts end, '%Y-%m-%dT%H:%M:%SZ') as captured_at, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as available_at from events")
def a2(t: Tables) -> DataFrame:
    path = scratch(t.spark, "odds")
    early = F.when(F.col("event_id") % 2 == 0, S.iso_utc(F.col("ts") - F.expr("interval 1 hour")))
    t.events.select("event_id", (1 + F.col("value")).alias("win_odds"), early.alias("captured_at"), S.iso_utc(F.col("ts")).alias("available_at")).write.option("header", True).csv(path)
    rows = L.load_odds_csv(t.spark, path, "event_id long, win_odds double, captured_at timestamp, available_at timestamp")
    return rows.withColumns({c: S.iso_utc(F.col(c)) for c in ("captured_at", "available_at")})


@query("A3_snapshot_source", "select c_custkey || '|' || c_name || '|' || c_mktsegment as line from customer")
def a3(t: Tables) -> DataFrame:
    path, base = scratch(t.spark, "source"), scratch(t.spark, "bronze")
    t.customer.select(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").alias("value")).write.text(path)
    first = L.snapshot(t.spark, f"{path}/*.txt", base, 4096)
    if L.snapshot(t.spark, f"{path}/*.txt", base, 4096) != first or L.latest_snapshot(t.spark, base) != f"{base}/{first}":
        raise ValueError("the same contents got another snapshot")
    ranges = t.spark.read.parquet(f"{L.latest_snapshot(t.spark, base)}/files")
    text = ranges.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("start", F.decode("content", "UTF-8").alias("s")))).alias("r"))
    lines = text.select(F.explode(F.split(F.array_join(F.transform("r", lambda x: x["s"]), ""), "\n")).alias("line"))
    return lines.where("line <> ''")


@query("A24_verify_manifest", """
    select c_name as name, case when c_custkey % 50 <> 0 then sha256(c_name) end as sha256,
        case when c_custkey % 50 = 0 then sha256(c_name) when c_custkey % 7 = 0 then sha256(c_mktsegment) end as found
    from customer where c_custkey % 50 = 0 or c_custkey % 7 = 0 or c_custkey % 11 = 0""")
def a24(t: Tables) -> DataFrame:
    """A file for each customer: one of 50 came after the manifest, of the others one of 7 was changed and one of 11 is gone."""
    target, k = scratch(t.spark, "bronze"), F.col("c_custkey")

    def write(rows: DataFrame, content: Column) -> None:
        name, start, length = F.col("c_name").alias("name"), F.lit(0).cast("long").alias("start"), F.length(content).cast("long").alias("length")
        rows.select(name, start, length, F.sha2(content, 256).alias("sha256"), content.cast("binary").alias("content")).write.mode("overwrite").parquet(f"{target}/files")

    write(t.customer.where(k % 50 != 0), F.col("c_name"))
    L.write_manifest(t.spark, target)
    write(t.customer.where((k % 50 == 0) | (k % 7 == 0) | (k % 11 != 0)), F.when((k % 50 != 0) & (k % 7 == 0), F.col("c_mktsegment")).otherwise(F.col("c_name")))
    return L.verify_manifest(t.spark, target)


@query("A4_read_ndjson", "select event_id, user_id, event_type, value from events where event_type <> 'error'")
def a4(t: Tables) -> DataFrame:
    path = scratch(t.spark, "ndjson")
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    rows.where("event_type <> 'error'").write.option("compression", "gzip").json(path)
    rows.where("event_type = 'error'").write.mode("append").json(path)
    return L.read_ndjson(t.spark, path, "event_id long, user_id long, event_type string, value double", r"\.json\.gz$").drop("file")


@query("A6_parse_fixed_width", "select o_orderkey, nullif(o_custkey, 7) as o_custkey, o_orderstatus from orders")
def a6(t: Tables) -> DataFrame:
    customer = F.when(F.col("o_custkey") == 7, "").otherwise(F.col("o_custkey").cast("string"))
    raw = F.concat(F.lit("RA"), F.lpad(F.col("o_orderkey").cast("string"), 12, " "), F.lpad(customer, 9, " "), F.col("o_orderstatus"))
    before = t.spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        layout = [("o_orderkey", 3, 12, "long"), ("o_custkey", 15, 9, "long"), ("o_orderstatus", 24, 1, "string")]
        path = scratch(t.spark, "parsed")
        L.parse_fixed_width(t.orders.select(raw.cast("binary").alias("raw")), "raw", layout).write.parquet(path)
    finally:
        t.spark.conf.set("spark.sql.legacy.javaCharsets", before)
    return t.spark.read.parquet(path)


PARTITIONED = "select l_orderkey, lpad(cast(l_linenumber as varchar), 2, '0') as part, l_quantity + case when l_linenumber = 2 then 1000 else 0 end as l_quantity from lineitem where l_linenumber <> 2 or l_quantity > 20"


def _partitioned(t: Tables) -> str:
    base = scratch(t.spark, "parts")
    rows = t.lineitem.select("l_orderkey", F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("part"), "l_quantity")
    L.write_partitioned(rows, base, ["part"])
    L.write_partitioned(rows.where("part = '02' and l_quantity > 20").withColumn("l_quantity", F.col("l_quantity") + 1000), base, ["part"])
    return base


@query("A11_write_partitioned", f"select part, count(*) as n, sum(l_quantity) as quantity from ({PARTITIONED}) group by part")
def a11(t: Tables) -> DataFrame:
    return t.spark.read.schema("l_quantity double, part string").parquet(_partitioned(t)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("A12_read_partitioned", PARTITIONED)
def a12(t: Tables) -> DataFrame:
    return L.read_partitioned(t.spark, _partitioned(t), "l_orderkey long, l_quantity double, part string")


@query("A17_upsert_run", """select sha256('base|' || o_orderpriority) as run_id, o_orderkey, o_totalprice + case when o_orderpriority like '1%' then 1 else 0 end as score
    from orders where o_orderpriority not like '1%' or o_totalprice > 1000""")
def a17(t: Tables) -> DataFrame:
    base = scratch(t.spark, "runs")
    rows = t.orders.withColumn("run_id", L.run_id("base", F.col("o_orderpriority"))).select("run_id", "o_orderkey", F.col("o_totalprice").alias("score"), "o_orderpriority")
    L.write_partitioned(rows.drop("o_orderpriority"), base, ["run_id"])
    for r in rows.where("o_orderpriority like '1%'").select("run_id").distinct().collect():  # the one run that is done again
        again = rows.where((F.col("run_id") == r["run_id"]) & (F.col("score") > 1000)).select("o_orderkey", (F.col("score") + 1).alias("score"))
        L.upsert_run(again, base, r["run_id"])
    return t.spark.read.schema("o_orderkey long, score double, run_id string").parquet(base)


@query("G7_hash_result", """select l_orderkey, sha256('{"p":[' || string_agg('"' || p || '"', ',' order by p) || '],"y":[' || string_agg('"' || y || '"', ',' order by y) || ']}') as hash
    from (select l_orderkey, l_linenumber || ':' || l_partkey as p, cast(l_suppkey as varchar) as y from lineitem) group by l_orderkey""")
def g7(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.concat_ws(":", "l_linenumber", "l_partkey")).alias("p"), F.collect_list(F.col("l_suppkey").cast("string")).alias("y"))
    return rows.select("l_orderkey", G.hash_result(F.col("p"), F.col("y")).alias("hash"))


@query("H14_market_blind", "select race_id, runner, finish_position from starts")
def h14(t: Tables) -> DataFrame:
    forbidden = ["win_odds", "popularity", "payout_yen"]
    try:
        V.assert_market_blind(t.once("starts"), forbidden)
    except ValueError:
        return V.assert_market_blind(t.once("starts").select("race_id", "runner", "finish_position"), forbidden)
    raise ValueError("a table with odds passed as market-blind")


NOW = "timestamp '2024-01-20 12:00:00'"
EDITION = f"""e as (select event_id as race, case user_id % 4 when 0 then 'G1' when 1 then 'G2' end as grade, cast(ts as date) as day, ts from events),
    f as (select race, grade, day, date_diff('second', date_trunc('second', ts), {NOW}) / 60.0 as age from e where grade is not null and race % 3 > 0
          union all select race, grade, day, null from e where grade is not null and race % 3 = 0),
    edition as (select race, grade, strftime(day, '%G-W%V') as edition_key, case when age is null then 'missing' when age <= 20000 then 'live' else 'stale' end as freshness from f)"""


def _edition(t: Tables) -> DataFrame:
    grade = F.when(F.col("user_id") % 4 == 0, "G1").when(F.col("user_id") % 4 == 1, "G2")
    races = t.events.select(F.col("event_id").alias("race"), grade.alias("grade"), F.col("ts").cast("date").alias("day"))
    snaps = t.events.where("event_id % 3 > 0").select(F.col("event_id").alias("race"), "ts")
    return A.live_edition(races, snaps, "race", "grade", "day", "ts", F.lit("2024-01-20 12:00:00").cast("timestamp"), 20000)


@query("I8_live_edition", f"with {EDITION} select race, grade, edition_key, freshness, freshness = 'live' as stamped from edition")
def i8(t: Tables) -> DataFrame:
    return _edition(t).select("race", "grade", "edition_key", "freshness", F.col("stamped_at").isNotNull().alias("stamped"))


@query("L8_rolling_edition", f"""with {EDITION}, s as (select race, v as version, 'old' as grade from edition cross join (select unnest([1, 90]) as v))
    select race, version, grade from s where version <> 90 or race not in (select race from edition where freshness = 'live')
    union all select race, 90, grade from edition where freshness = 'live'""")
def l8(t: Tables) -> DataFrame:
    edition = _edition(t)
    stored = edition.select("race", F.explode(F.array(F.lit(1), F.lit(90))).alias("version"), F.lit("old").alias("grade"))
    return A.rolling_edition(stored, edition, "race")


@query("I16_day_pipeline", """select 'silver' as layer, count(*) as n_rows from lineitem union all select 'gold', count(*) from lineitem
    union all select 'mart', count(distinct l_orderkey) from lineitem union all select 'bronze_files', 4""")
def i16(t: Tables) -> DataFrame:
    folder = scratch(t.spark, "day")
    t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition(4, "l_orderkey").write.option("header", True).csv(folder)
    return C.day_pipeline(t.spark, f"{folder}/*.csv", scratch(t.spark, "lake"), "l_orderkey long, l_linenumber int, l_quantity double", "l_orderkey", "l_linenumber")


def _streamed(t: Tables, rows: DataFrame) -> DataFrame:
    path = scratch(t.spark, "arriving")
    rows.write.json(path)
    return T.read_stream(t.spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("L1_payload_ingest", "select event_id, '01' as sel, 1 + value as win_odds, cast(user_id as int) as popularity from events")
def l1(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"status":"ok","data":{"official_datetime":null,"odds":{"1":{"01":["'), (1 + F.col("value")).cast("string"), F.lit('","","'), F.col("user_id").cast("string"), F.lit('"]}}}}'))
    stream = _streamed(t, t.events.select("event_id", F.col("ts").cast("string").alias("ts"), body.alias("payload")))
    raw, silver = scratch(t.spark, "raw"), scratch(t.spark, "silver")
    T.ingest_payloads(stream, raw, silver, scratch(t.spark, "ck"), lambda batch: L.flatten_odds(batch, "payload", "ts").select("event_id", "sel", "win_odds", "popularity")).awaitTermination()
    archived = t.spark.read.parquet(raw).select("event_id")
    return t.spark.read.parquet(silver).drop("batch").join(archived, "event_id", "left_semi")


@query("L3_stream_dedupe", "select distinct user_id, event_type from events")
def l3(t: Tables) -> DataFrame:
    # One timestamp for all rows, so that the watermark keeps every key for the whole run.
    stream = _streamed(t, t.events.select("user_id", "event_type")).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    out = scratch(t.spark, "once")
    T.dedupe_stream(stream, ["user_id", "event_type"], "at").writeStream.option("checkpointLocation", scratch(t.spark, "ck")).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("user_id", "event_type")


@query("L3exact_dedupe", "select distinct user_id, event_type, ts from events")
def l3_for_ever(t: Tables) -> DataFrame:
    # Every event comes twice, the second time in a later batch and late by as much as the table is long.
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    path, out, checkpoint = scratch(t.spark, "arriving"), scratch(t.spark, "once"), scratch(t.spark, "ck")
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz"
    for part in (rows.where("event_id % 3 <> 0"), rows):
        part.write.mode("append").parquet(path)
        T.append_once(T.read_stream(t.spark, path, schema, "parquet"), out, checkpoint, ["user_id", "event_type"], "ts", ["event_id"], buckets=1).awaitTermination()
    return t.spark.read.schema(schema).parquet(out).select("user_id", "event_type", "ts")


@query("L4_late_data", "select user_id, max(event_id) as last_known from events where event_id % 100 <= 60 group by user_id")
def l4(t: Tables) -> DataFrame:
    # Every row is kept, whenever it comes; only what was available by the decision counts.
    stream = _streamed(t, t.events.select("event_id", "user_id", (F.col("event_id") % 100).alias("available")))
    out = scratch(t.spark, "late")
    T.append_batches(stream, out, scratch(t.spark, "ck"), ["event_id"], ["available"]).awaitTermination()
    return t.spark.read.parquet(out).where("available <= 60").groupBy("user_id").agg(F.max("event_id").alias("last_known"))


@query("L9_settle_on_arrival", "select ticket_id, 'open' as old_state, case when ticket_id % 2 = 0 then 'won' else 'miss' end as new_state from tickets where state = 'open' and user_id % 3 <> 0")
def l9(t: Tables) -> DataFrame:
    tickets = t.tickets.select("ticket_id", F.col("user_id").alias("race_id"), "state", "returned", F.lit(None).cast("string").alias("seen_hash"))
    results = _streamed(t, tickets.where("race_id % 3 <> 0").select("race_id").distinct().withColumn("hash", F.sha2(F.col("race_id").cast("string"), 256)))
    out = scratch(t.spark, "settled")

    def settle(batch: DataFrame) -> None:
        new = F.when(F.col("ticket_id") % 2 == 0, "won").otherwise("miss")
        due = tickets.where("state = 'open'").join(batch.select("race_id"), "race_id", "left_semi")
        resolved = due.select("ticket_id", new.alias("state"), F.lit(0.0).alias("returned"))
        C.settle_sweep(due, resolved, batch.select("race_id", "hash"), 2**31 - 1).write.mode("append").parquet(out)

    T.on_arrival(results, scratch(t.spark, "ck"), settle).awaitTermination()
    return t.spark.read.parquet(out).select("ticket_id", "old_state", "new_state")


@query("S2_parse_as_of", """select event_id, strftime(case when event_id % 3 = 0 then timestamp '2024-01-01' when event_id % 2 = 0 then ts else ts - interval 9 hour end, '%Y-%m-%dT%H:%M:%SZ') as as_of from events""")
def s2(t: Tables) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, "soon").when(F.col("event_id") % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(text)
    return t.events.select("event_id", S.iso_utc(S.parse_as_of(text, F.lit("2024-01-01").cast("timestamp"))).alias("as_of"))


@query("S6_normalize_name", "select c_custkey, nullif(regexp_replace(case when c_custkey % 5 = 0 then '' else c_name end, '[\\s]', '', 'g'), '') as name from customer")
def s6(t: Tables) -> DataFrame:
    wide = F.translate("c_name", "0123456789", "０１２３４５６７８９")
    return t.customer.select("c_custkey", S.normalize_name(F.when(F.col("c_custkey") % 5 == 0, "　 ").otherwise(F.concat(F.lit(" "), wide))).alias("name"))


@query("S15_half_even", "select l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) as half from lineitem")
def s15(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", S.half_even(F.col("l_quantity") / 2).alias("half"))


@query("S17_canonical_grade", "select event_id, case event_id % 8 when 0 then 'G1' when 1 then 'G1' when 2 then 'G2' when 3 then 'G3' when 4 then 'G3' end as grade from events")
def s17(t: Tables) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in ("Ｇ１", "GⅠ", "g2", " GIII ", "G3", "OP", "JpnI", "")])
    return t.events.select("event_id", S.canonical_grade(F.get(labels, (F.col("event_id") % 8).cast("int"))).alias("grade"))


@query("U2_iter_groups", "select l_suppkey, count(*) as n, max(l_quantity) - min(l_quantity) as spread from lineitem group by 1")
def u2(t: Tables) -> DataFrame:
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        q = rows["l_quantity"]
        return pd.DataFrame({"l_suppkey": rows["l_suppkey"].iloc[:1], "n": [len(rows)], "spread": [q.max() - q.min()]})

    return C.per_group(t.lineitem.select("l_suppkey", "l_quantity"), ["l_suppkey"], work, "l_suppkey long, n long, spread double")


@query("U2fold_groups", "select l_suppkey, count(*) as n, max(gap) as longest from (select l_suppkey, date_diff('day', lag(l_shipdate) over (partition by l_suppkey order by l_shipdate), l_shipdate) as gap from lineitem) group by 1")
def u2_fold(t: Tables) -> DataFrame:
    # Longest time without a shipment: the last day of a batch is what the next one needs.
    def step(state: tuple, rows: pd.DataFrame) -> tuple:
        n, longest, day = state
        days = ([] if day is None else [day]) + rows["day"].to_list()
        return n + len(rows), max([longest, *(b - a for a, b in zip(days, days[1:]))]), days[-1]

    def finish(key: tuple, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({"l_suppkey": [key[0]], "n": [state[0]], "longest": [state[1] if state[0] > 1 else None]})

    rows = t.lineitem.select("l_suppkey", F.unix_date(F.col("l_shipdate").cast("date")).alias("day"))
    return C.fold_groups(rows, ["l_suppkey"], ["day"], lambda: (0, 0, None), step, finish, "l_suppkey long, n long, longest long")


@query("U4_converters", "select o_orderkey, nullif(o_custkey % 1000, 0) / 10.0::double as tenths, o_orderstatus as status, o_custkey as whole from orders")
def u4(t: Tables) -> DataFrame:
    raw = t.orders.select("o_orderkey", F.lpad((F.col("o_custkey") % 1000).cast("string"), 4, "0").alias("tenths"), F.concat(F.lit(" "), "o_orderstatus").alias("status"), F.lpad(F.col("o_custkey").cast("string"), 9, " ").alias("whole"))
    return S.converted(raw, {"tenths": "tenths", "status": "text", "whole": "whole"})


@query("U5_grid_best", """with g as (select l_suppkey, g, sum((l_quantity - g) * (l_quantity - g)) as loss from lineitem cross join (select unnest([10.0, 20.0, 30.0])::double as g) group by 1, 2)
    select l_suppkey, arg_min(g, loss + g * 1e-9) as best, min(loss) as loss from g group by 1""")
def u5(t: Tables) -> DataFrame:
    return C.grid_best(t.lineitem, ["l_suppkey"], [10, 20, 30], lambda g: (F.col("l_quantity") - g) * (F.col("l_quantity") - g))


@query("U6_combos", "select a.l_orderkey, a.l_linenumber as a, b.l_linenumber as b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber")
def u6(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("s"))
    a = items.select("l_orderkey", "s", F.explode("s").alias("a"))
    return a.select("l_orderkey", "a", F.explode(F.filter("s", lambda b: b > F.col("a"))).alias("b"))


@query("A14_upsert_files", """
    with s as (select race_id % 5 as venue, year(race_date) as year, race_id, runner, win_odds as v, available_at from starts),
         n as (select venue, year, race_id, runner, v + 100 as v, case when race_id % 2 = 0 then available_at else available_at + interval 1 day end as available_at
               from s where runner = 2 and venue = 3 and year <= 1994),
         m as (select * from s where not exists (select 1 from n where n.race_id = s.race_id and n.runner = s.runner and n.available_at = s.available_at
                      and exists (select 1 from n x where x.venue = s.venue and x.year = s.year and x.race_id % 2 = 1))
               union all select * from n where exists (select 1 from n x where x.venue = n.venue and x.year = n.year and x.race_id % 2 = 1))
    select year, venue, count(*) as n, round(sum(v), 4) as total, count(*) filter (v > 100) as new_values,
           not exists (select 1 from n where n.venue = m.venue and n.year = m.year and n.race_id % 2 = 1) as same_files, (select count(*) from n where race_id % 2 = 1) as new_keys
    from m group by year, venue""")  # fmt: skip
def a14_files(t: Tables) -> DataFrame:
    base, by = scratch(t.spark, "silver"), ["year", "venue"]
    s = t.starts.select("race_id", "runner", F.col("win_odds").alias("v"), F.col("available_at").cast("date").alias("available_at"), F.year("race_date").alias("year"), (F.col("race_id") % 5).alias("venue"))
    L.partition_upsert(s, base, by, ["race_id", "runner"], "available_at", "v")
    later = F.when(F.col("race_id") % 2 == 0, F.col("available_at")).otherwise(F.date_add("available_at", 1))
    new = s.where("runner = 2 and venue = 3 and year <= 1994").withColumns({"v": F.col("v") + 100, "available_at": later})

    def files() -> DataFrame:
        rows = t.spark.read.schema(s.schema).parquet(base)
        return rows.groupBy(*by).agg(F.array_sort(F.collect_set("_metadata.file_name")).alias("files"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"), F.count_if(F.col("v") > 100).alias("new_values"))

    before = stored(files().select(*by, F.col("files").alias("before")), "files")
    n = L.partition_upsert(new, base, by, ["race_id", "runner"], "available_at", "v")
    if L.partition_upsert(new, base, by, ["race_id", "runner"], "available_at", "v"):
        raise ValueError("the same rows had new keys again")
    return files().join(before, by).select(*by, "n", "total", "new_values", (F.col("files") == F.col("before")).alias("same_files"), F.lit(n).cast("long").alias("new_keys"))


@query("L6_watchdog_stream", """
    with c as (select event_type as source, date_trunc('hour', ts) as h, count(*) filter (value >= 60) as ok, count(*) filter (value < 60) as failed from events group by 1, 2),
         w as (select max(h) as top from c),
         g as (select *, sum((ok > 0)::int) over (partition by source order by h) as g from c),
         s as (select *, sum((ok = 0 and failed > 0)::int) over (partition by source, g order by h) as n from g),
         good as (select source, h, lag(h) over (partition by source order by h) as earlier, coalesce(lead(h) over (partition by source order by h), top) as until, g from c join g using (source, h, ok, failed), w where ok > 0),
         stale as (select source, h + interval 1 second * (7200 + 3600 * k) as "at" from good, range(0, 5000) t(k) where h + interval 1 second * (7200 + 3600 * k) < until),
         failing as (select source, h as "at" from s where ok = 0 and failed > 0 and n >= 3)
    select source, "at", 'stale' as alert from stale union all select source, "at", 'failing' from failing
    union all select source, h, 'recovered' from good x where exists (select 1 from stale y where y.source = x.source and y."at" >= x.earlier and y."at" < x.h)
        or exists (select 1 from failing f where f.source = x.source and f."at" < x.h and (x.earlier is null or f."at" > x.earlier))""")  # fmt: skip
def l6_stream(t: Tables) -> DataFrame:
    by = t.events.groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", "ts").alias("h"))
    rows = by.agg(F.count_if(F.col("value") >= 60).alias("ok"), F.count_if(F.col("value") < 60).alias("failed"))
    path, out = scratch(t.spark, "cycles"), scratch(t.spark, "alerts")
    rows.write.parquet(path)
    cycles = T.read_stream(t.spark, path, "source string, h timestamp, ok long, failed long", "parquet")
    alerts = T.watchdog_stream(cycles, "source", "h", "ok", "failed", least=3, stale=7200, cooldown=3600)
    alerts.writeStream.option("checkpointLocation", scratch(t.spark, "ck")).option("path", out).format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("source string, at timestamp, alert string").parquet(out).withColumn("at", F.col("at").cast("timestamp_ntz"))
