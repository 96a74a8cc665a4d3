"""Domain views over the driver tables: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.lake import exists

SQL = {
    "odds_ts": """
        select concat(event_type, '-', cast(cast(ts as date) as varchar(10))) as race_id,
               event_type as pool, cast(user_id % 12 + 1 as int) as runner,
               date_trunc('hour', ts) as available_at,
               date_trunc('day', ts) + interval '1' day as post_time,
               max_by(1.0 + value, event_id) as win_odds
        from events group by 1, 2, 3, 4, 5""",
    "starts": """
        select l.l_orderkey as race_id, l.l_linenumber as runner, l.l_partkey as horse_id,
               l.l_suppkey as jockey_id, o.o_custkey as trainer_id, o.o_orderdate as race_date,
               o.o_orderpriority as racecourse, o.o_orderstatus as surface,
               cast(l.l_quantity as int) % 4 + 1 as going_wetness,
               1.0 + l.l_quantity as win_odds, l.l_extendedprice / 1000.0 as finish_time_seconds,
               l.l_shipdate as available_at,
               row_number() over (partition by l.l_orderkey order by l.l_extendedprice desc, l.l_linenumber) as finish_position
        from (select li.*, row_number() over (partition by l_orderkey, l_linenumber
                order by l_shipdate desc, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem li) l
        join orders o on o.o_orderkey = l.l_orderkey where l.rn = 1""",
    "payouts": """
        select race_id, 'win' as pool, lpad(cast(runner as varchar(10)), 2, '0') as combo,
               cast(win_odds * 100 as bigint) as payout_yen, available_at
        from starts where finish_position = 1""",
    "edges": """
        select distinct user_id as source_id, (event_id * 7) % 150 as target_id,
               case when event_type = 'click' then 'accepted' else 'pending' end as state
        from events where user_id <> (event_id * 7) % 150 and event_type in ('click', 'signup')""",
    "tickets": """
        select event_id as ticket_id, user_id, ts as created_at,
               case event_type when 'purchase' then 'won' when 'error' then 'refunded'
                    when 'view' then 'open' else 'miss' end as state,
               100 * (event_id % 9 + 1) as cost,
               case when event_type = 'purchase' then cast(floor(value * 10) as bigint) end as returned,
               props as payload
        from events""",
}


def _odds_ts(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return t.events.groupBy(
        F.concat_ws("-", "event_type", F.col("ts").cast("date").cast("string")).alias("race_id"),
        F.col("event_type").alias("pool"), (F.col("user_id") % 12 + 1).cast("int").alias("runner"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("available_at"),
        (day + F.expr("interval 1 day")).alias("post_time"),
    ).agg(F.max_by(F.lit(1.0) + F.col("value"), "event_id").alias("win_odds"))


def _starts(t: Tables) -> DataFrame:
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice"
    )
    place = Window.partitionBy("race_id").orderBy(F.desc("l_extendedprice"), "runner")
    # Dealt by race once: what follows keeps to that, and no row moves a second time.
    lines = t.lineitem.repartition("l_orderkey").withColumn("rn", F.row_number().over(same)).where("rn = 1")
    return (
        lines.join(t.orders, lines["l_orderkey"] == t.orders["o_orderkey"])
        .select(
            F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("runner"), F.col("l_partkey").alias("horse_id"),
            F.col("l_suppkey").alias("jockey_id"), F.col("o_custkey").alias("trainer_id"), F.col("o_orderdate").alias("race_date"),
            F.col("o_orderpriority").alias("racecourse"), F.col("o_orderstatus").alias("surface"),
            (F.col("l_quantity").cast("int") % 4 + 1).alias("going_wetness"), (1.0 + F.col("l_quantity")).alias("win_odds"),
            (F.col("l_extendedprice") / 1000.0).alias("finish_time_seconds"), F.col("l_shipdate").alias("available_at"),
            "l_extendedprice",
        )
        .withColumn("finish_position", F.row_number().over(place))
        .drop("l_extendedprice")
    )


def _payouts(t: Tables) -> DataFrame:
    return t.starts.where("finish_position = 1").select(
        "race_id", F.lit("win").alias("pool"), F.lpad(F.col("runner").cast("string"), 2, "0").alias("combo"),
        (F.col("win_odds") * 100).cast("long").alias("payout_yen"), "available_at",
    )


def _edges(t: Tables) -> DataFrame:
    target = (F.col("event_id") * 7) % 150
    return (
        t.events.where(F.col("event_type").isin("click", "signup") & (F.col("user_id") != target))
        .select(
            F.col("user_id").alias("source_id"), target.alias("target_id"),
            F.when(F.col("event_type") == "click", "accepted").otherwise("pending").alias("state"),
        )
        .distinct()
    )


def _tickets(t: Tables) -> DataFrame:
    e = F.col("event_type")
    state = F.when(e == "purchase", "won").when(e == "error", "refunded").when(e == "view", "open").otherwise("miss")
    return t.events.select(
        F.col("event_id").alias("ticket_id"), "user_id", F.col("ts").alias("created_at"), state.alias("state"),
        (100 * (F.col("event_id") % 9 + 1)).alias("cost"),
        F.when(e == "purchase", F.floor(F.col("value") * 10).cast("long")).alias("returned"), F.col("props").alias("payload"),
    )


class Tables:
    """Driver tables and domain views by name, read on demand: ``t.lineitem``, ``t.starts``."""

    _views = {"odds_ts": _odds_ts, "starts": _starts, "payouts": _payouts, "edges": _edges, "tickets": _tickets}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        view = self._views.get(name)
        if name == "starts":
            df = self._once(name, view)
        else:
            df = view(self) if view else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, df)
        return df

    def once(self, name: str) -> DataFrame:
        """A view for a query that reads it a single time: not stored, so only the columns in use are read and moved."""
        return self._views[name](self)

    def _once(self, name: str, view: Callable[[Tables], DataFrame]) -> DataFrame:
        """A view that most queries use, stored once for an application and folder; computed again if its files are gone."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored or not exists(self.spark, _stored[key]):
            _stored[key] = scratch(self.spark, name)
            view(self).write.parquet(_stored[key])
        return self.spark.read.parquet(_stored[key])


_stored: dict[tuple[str, str, str], str] = {}
