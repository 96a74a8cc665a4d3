"""Streams of captured payloads and events: ingest, deduplication, change detection, watchdog and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.market import carry_first, residual_drift
from ..session import stored
from ..sources.lake import append_new, exists


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def changed(df: DataFrame, key: Sequence[str], time: str, digest: str) -> DataFrame:
    """Batch form of change detection: rows whose hash isn't that of the row before."""
    w = Window.partitionBy(*key).orderBy(time)
    return df.withColumn("_before", F.lag(digest).over(w)).where(~F.col(digest).eqNullSafe(F.col("_before"))).drop("_before")


def changed_stream(df: DataFrame, key: str, digest: str, schema: str) -> DataFrame:
    """Stream form: the last hash of each key is kept as state; rows that repeat it are dropped."""

    def keep(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            before = f[digest].shift(1)
            before.iloc[0] = last
            yield f[f[digest] != before]
            last = f[digest].iloc[-1]
        state.update((last,))

    return df.groupBy(key).applyInPandasWithState(keep, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def dedupe_stream(df: DataFrame, key: Sequence[str], time: str, late: str = "10 minutes") -> DataFrame:
    """One row per key within the watermark; exact deduplication for ever is ``append_batches``."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def append_batches(df: DataFrame, path: str, checkpoint: str, key: Sequence[str], ties: Sequence[str]) -> StreamingQuery:
    """Append each batch's new keys to a table; late rows are accepted, the point-in-time filter decides at reading."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        have = spark.read.schema(batch.schema).parquet(path) if exists(spark, path) else batch.limit(0)
        append_new(batch, have, key, ties).write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(df: DataFrame, path: str, checkpoint: str, key: Sequence[str], time: str, ties: Sequence[str], buckets: int = 16) -> StreamingQuery:
    """Deduplication for ever on key and event time: of rows that agree in both the first one that came, by ``ties`` within a batch.

    The table lies in partitions by the day of ``time`` and a bucket of the key's hash, ``_day`` and ``_bucket``. What a key may
    match has its day and bucket, so a batch reads the partitions of its own days and buckets alone, however long the table
    is, and of their files only those whose Bloom filters of ``_hash`` may hold one of its keys. A batch that is done again
    finds its rows there. Nulls match each other.
    """
    both = [*key, time]

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.date_format(time, "yyyyMMdd"), F.lit("none"))
        first = Window.partitionBy(*both).orderBy(*ties)
        new = batch.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn").withColumn("_hash", F.xxhash64(*both))
        new = stored(new.withColumns({"_day": day, "_bucket": F.pmod("_hash", F.lit(buckets)).cast("int")}), "batch")
        if exists(spark, path):
            places = new.select("_day", "_bucket").distinct().collect()  # days of a batch times buckets
            old = spark.read.schema(new.schema).parquet(path).where(F.col("_day").isin({r["_day"] for r in places}) & F.col("_bucket").isin({r["_bucket"] for r in places}))
            same = old["_hash"] == new["_hash"]
            for c in both:
                same &= old[c].eqNullSafe(new[c])
            new = new.join(old.select("_hash", *both), same, "left_anti")
        out = new.hint("rebalance", "_day", "_bucket").write.option("parquet.bloom.filter.enabled#_hash", "true").partitionBy("_day", "_bucket")
        out.mode("append").parquet(path)

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_payloads(df: DataFrame, raw: str, silver: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Archive every batch of payloads as it came, then append what ``parse`` makes of it. A batch that is done again after
    a failure replaces its own files."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number))
        batch.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(raw)
        kept = batch.sparkSession.read.schema(batch.schema).parquet(raw).where(F.col("batch") == number).drop("batch")
        parse(kept).withColumn("batch", F.lit(number)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(silver)

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track(df: DataFrame, group: Sequence[str], item: str, time: str, price: str) -> DataFrame:
    """What a cycle of the live track shows: first-seen price, latest price and the drift flag of each item."""
    keys = [*group, item]
    opened = df.withColumn("opening", carry_first(price, keys, [time]))
    last = opened.groupBy(*keys).agg(F.max_by(price, time).alias("now"), F.max_by("opening", time).alias("opening"))
    return residual_drift(last, group, "now", "opening")


def watchdog(cycles: DataFrame, time: str, failed: str, least: int = 3, cooldown: int = 900) -> DataFrame:
    """Replay of the capture alerts: one after ``least`` total failures in a row, no more within the cooldown, and a
    recovery notice at the first success after an alert."""
    w = Window.orderBy(time)
    runs = cycles.withColumn("_g", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("_g").orderBy(time)
    streak = runs.withColumn("_n", F.sum(F.col(failed).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(F.when(F.col("_n") >= least, F.unix_timestamp(F.col(time).cast("timestamp")))).over(Window.partitionBy("_g"))
    step = F.floor((F.unix_timestamp(F.col(time).cast("timestamp")) - start) / cooldown)
    due = streak.withColumn("_step", F.when(F.col("_n") >= least, step))
    first = due.withColumn("_before", F.lag("_step").over(inside))
    alert = F.col("_step").isNotNull() & ~F.col("_step").eqNullSafe(F.col("_before"))
    out = first.withColumn("alert", F.when(alert, "failing"))
    had = F.lag("_step").over(w)
    return out.withColumn("alert", F.coalesce("alert", F.when(~F.col(failed) & had.isNotNull(), "recovered"))).where("alert is not null").select(time, "alert")


class Alerts:
    """The capture alerts of one source, cycle by cycle, in whole seconds.

    ``failing``: ``least`` cycles in a row without a success. ``stale``: no success for ``stale`` seconds, whether cycles come
    or not. Neither is repeated within ``cooldown`` seconds. ``recovered``: the first success after either. A source without
    any success yet isn't stale.
    """

    def __init__(self, least: int, stale: int, cooldown: int, kept: tuple | None = None):
        self.least, self.stale, self.cooldown = least, stale, cooldown
        self.failures, self.ok_at, self.failing_at, self.due, self.alerting = kept or (0, None, None, None, False)

    def kept(self) -> tuple:
        return self.failures, self.ok_at, self.failing_at, self.due, self.alerting

    def until(self, at: int) -> Iterator[tuple[int, str]]:
        """What fell due before ``at`` because nothing came."""
        while self.due is not None and self.due < at:
            self.alerting = True
            yield self.due, "stale"
            self.due += self.cooldown

    def cycle(self, at: int, ok: int, failed: int) -> Iterator[tuple[int, str]]:
        yield from self.until(at)
        if ok > 0:
            if self.alerting:
                yield at, "recovered"
            self.failures, self.ok_at, self.failing_at, self.due, self.alerting = 0, at, None, at + self.stale, False
            return
        self.failures += failed > 0
        if self.failures >= self.least and (self.failing_at is None or at - self.failing_at >= self.cooldown):
            self.failing_at, self.alerting = at, True
            yield at, "failing"


def watchdog_stream(
    cycles: DataFrame, key: str, time: str, ok: str, failed: str, least: int = 3, stale: int = 900, cooldown: int = 900, late: str = "0 seconds"
) -> DataFrame:
    """Alerts (key, ``at``, ``alert``) of a stream of capture cycles with the numbers of races that succeeded and failed.

    The state of a source is five numbers. A timer on the event time wakes a source of which nothing comes: then the
    watermark, which other sources move, tells that it is stale. A batch's cycles are taken in order of time; one that is older
    than what was seen of its source is left out.
    """
    kind = cycles.schema[key].dataType.simpleString()
    second = F.unix_timestamp(F.col(time).cast("timestamp"))
    rows = cycles.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time).alias("event_time"), second.alias("at"), F.col(ok).alias("ok"), F.col(failed).alias("failed"))

    def run(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = tuple(state.get) if state.exists else None
        alerts, seen = Alerts(least, stale, cooldown, kept[:5] if kept else None), kept[5] if kept else None
        out: list[tuple[int, str]] = []
        if state.hasTimedOut:
            out += alerts.until(state.getCurrentWatermarkMs() // 1000)
        else:
            batch = pd.concat(list(frames)).sort_values(["at", "ok"])  # one source's cycles since the last trigger
            for at, good, bad in zip(batch["at"].tolist(), batch["ok"].tolist(), batch["failed"].tolist(), strict=True):
                if seen is None or at >= seen:
                    out += alerts.cycle(at, good, bad)
                    seen = at
        state.update((*alerts.kept(), seen))
        if alerts.due is not None:
            state.setTimeoutTimestamp(max(alerts.due * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [own[0]] * len(out), "at": [a for a, _ in out], "alert": [k for _, k in out]})

    kept = "failures long, ok_at long, failing_at long, due long, alerting boolean, seen long"
    found = rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, at long, alert string", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_seconds("at").alias("at"), "alert")


def on_arrival(df: DataFrame, checkpoint: str, work: Callable[[DataFrame], None]) -> StreamingQuery:
    """Run ``work`` on each batch of arriving results (settlement, card or edition updates)."""
    return df.writeStream.foreachBatch(lambda batch, _: work(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
