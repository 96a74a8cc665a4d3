"""Files and streams."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parimart.sources import lake as L
from parimart.streaming import ingest as T


def test_csv_blanks_and_times(spark, tmp_path):
    (tmp_path / "odds.csv").write_text("race_id,win_odds,captured_at,available_at\nr1,,,2024-01-01T00:00:00\nr2,x,2024-01-01 01:00:00,2024-01-01T02:00:00Z\n")
    rows = L.load_odds_csv(spark, str(tmp_path), "race_id string, win_odds double, captured_at timestamp, available_at timestamp").orderBy("race_id").collect()
    assert [r.win_odds for r in rows] == [None, None] and rows[0].captured_at == rows[0].available_at and rows[1].captured_at != rows[1].available_at


def test_snapshot_is_content_addressed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x\n1\n")
    a = L.snapshot(spark, str(tmp_path / "in"), str(tmp_path / "lake"))
    assert a == L.snapshot(spark, str(tmp_path / "in"), str(tmp_path / "lake"))
    assert L.verify_manifest(spark, f"{tmp_path}/lake/{a}").isEmpty()
    (tmp_path / "in" / "a.csv").write_text("x\n2\n")
    assert a != L.snapshot(spark, str(tmp_path / "in"), str(tmp_path / "lake"))


def test_snapshot_of_large_files_by_ranges(spark, tmp_path):
    inside, lake = tmp_path / "in put", str(tmp_path / "lake")
    inside.mkdir()
    big, files = bytes(range(256)) * 40, {"big.bin": 0, "é 1%.csv": b"x,y\n", "empty.csv": b""}
    files["big.bin"] = big + b"end"
    for name, content in files.items():
        (inside / name).write_bytes(content)
    assert L.latest_snapshot(spark, lake) is None
    a = L.snapshot(spark, str(inside), lake, 1000)
    rows = spark.read.parquet(f"{lake}/{a}/files").orderBy("name", "start").collect()
    got = {}
    for r in rows:
        assert r.start == len(got.get(r.name, b"")) and r.length == len(r.content) <= 1000
        got[r.name] = got.get(r.name, b"") + bytes(r.content)
    assert got == files and sum(r.name == "big.bin" for r in rows) == 11
    kept = {r.name: (r.sha256, r.length) for r in L.read_manifest(spark, f"{lake}/{a}").collect()}
    parts = "".join(hashlib.sha256(files["big.bin"][i : i + 1000]).hexdigest() for i in range(0, len(files["big.bin"]), 1000))
    assert kept == {n: (hashlib.sha256(parts.encode() if n == "big.bin" else c).hexdigest(), len(c)) for n, c in files.items()}
    assert L.verify_manifest(spark, f"{lake}/{a}").isEmpty() and L.latest_snapshot(spark, lake) == f"{lake}/{a}"
    (inside / "big.bin").write_bytes(b"0" + files["big.bin"][1:])
    b = L.snapshot(spark, str(inside), lake, 1000)
    assert b != a and L.latest_snapshot(spark, lake) == f"{lake}/{b}"
    (inside / "big.bin").write_bytes(files["big.bin"])
    before = sorted(p.name for p in (tmp_path / "lake" / a / "files").iterdir())
    assert L.snapshot(spark, str(inside), lake, 1000) == a and L.latest_snapshot(spark, lake) == f"{lake}/{a}"
    assert before == sorted(p.name for p in (tmp_path / "lake" / a / "files").iterdir())
    assert not [p for p in (tmp_path / "lake").iterdir() if p.name.startswith((".staged", ".latest-"))]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        L.snapshot(spark, str(tmp_path / "none"), lake)


def test_only_touched_partitions_are_replaced(spark, tmp_path):
    base = str(tmp_path / "t")
    L.write_partitioned(spark.createDataFrame([(1, 2024, "06"), (2, 2024, "07")], "v int, year int, venue string"), base, ["year", "venue"])
    L.write_partitioned(spark.createDataFrame([(9, 2024, "06")], "v int, year int, venue string"), base, ["year", "venue"])
    got = sorted((r.v, r.venue) for r in L.read_partitioned(spark, base, "v int, extra int, year int, venue string").collect())
    assert got == [(2, "07"), (9, "06")]


def test_ndjson_by_name(spark, tmp_path):
    (tmp_path / "RA_1.ndjson").write_text('{"k": 1}\n')
    (tmp_path / "SE_1.ndjson").write_text('{"k": 2}\n')
    assert [r.k for r in L.read_ndjson(spark, str(tmp_path), "k int", "^RA").collect()] == [1]


def test_fixed_width(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = "ＡＢ0123 ".encode("cp932")
    out = L.parse_fixed_width(spark.createDataFrame([(bytearray(raw),)], "raw binary"), "raw", [("name", 1, 4, "string"), ("n", 5, 4, "int"), ("gap", 9, 1, "string")]).first()
    assert (out.name, out.n, out.gap) == ("ＡＢ", 123, None)


def test_versions_leave_rows_alone(spark):
    a = spark.createDataFrame([("r", 1, 1)], "g string, x int, version int")
    b = L.append_versioned(a, spark.createDataFrame([("r", 5), ("s", 6)], "g string, x int"), ["g"])
    assert sorted(tuple(r) for r in b.select("g", "x", "version").collect()) == [("r", 5, 2), ("s", 6, 1)]
    assert L.unchanged(a, a.unionByName(b)) and not L.unchanged(a, b)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("r", 1, "2024-01-01 00:00:00", "a"), ("r", 1, "2024-01-01 00:00:00", "a"), ("r", 2, "2024-01-01 00:01:00", "b")]
    df = spark.createDataFrame(rows, "race string, runner int, at string, h string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.json(src)
    schema = "race string, runner int, at timestamp, h string"
    out, key = str(tmp_path / "out"), ["race", "runner", "at"]
    for n in range(2):  # a second stream over the same files adds nothing
        T.append_batches(T.read_stream(spark, src, schema), out, str(tmp_path / f"c{n}"), key, ["h"]).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    q = T.dedupe_stream(T.read_stream(spark, src, schema), key, "at").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 2
    c = T.changed_stream(T.read_stream(spark, src, schema), "race", "h", schema).writeStream.format("memory").queryName("changes").trigger(availableNow=True).start()
    c.awaitTermination()
    assert spark.table("changes").count() == 2


def test_watchdog(spark):
    rows = [("2024-01-01 00:%02d:00" % i, i in (1, 2, 3, 4, 5)) for i in range(8)]
    df = spark.createDataFrame(rows, "at string, failed boolean").withColumn("at", F.col("at").cast("timestamp"))
    got = [(r.at.minute, r.alert) for r in T.watchdog(df, "at", "failed", least=3).orderBy("at").collect()]
    assert got == [(3, "failing"), (6, "recovered")]


def _table(spark, rows):
    return spark.createDataFrame(rows, "id long, year int, venue string, at date, v double, seq int")


def _files(spark, base):
    rows = spark.read.parquet(base).select("year", "venue", F.col("_metadata.file_name").alias("f")).distinct().collect()
    out = {}
    for r in rows:
        out.setdefault((r.year, str(r.venue)), set()).add(r.f)
    return out


def test_partition_upsert_touches_what_it_must(spark, tmp_path):
    base, day = f"{tmp_path}/silver", lambda n: dt.date(2024, 1, n)
    args = (base, ["year", "venue"], ["id"], "at", "seq")
    assert L.partition_upsert(_table(spark, [(i, 2023 + i % 2, "ab"[i % 3 == 0], day(1), 1.0 * i, 0) for i in range(40)]), *args) == 40
    before = _files(spark, base)
    # Same keys with other values: no new key, so nothing is written.
    assert L.partition_upsert(_table(spark, [(2, 2023, "a", day(1), 99.0, 1)]), *args) == 0
    assert _files(spark, base) == before
    # A new instant is a new row, of equal keys the highest order counts, an old key in that partition is replaced.
    new = [(2, 2023, "a", day(2), 5.0, 1), (2, 2023, "a", day(2), 6.0, 2), (4, 2023, "a", day(1), 77.0, 1), (None, 2023, "a", day(1), 8.0, 1), (50, 2030, "c", day(1), 1.0, 1)]
    assert L.partition_upsert(_table(spark, new), *args) == 3
    assert L.partition_upsert(_table(spark, new), *args) == 0
    after = _files(spark, base)
    assert {k for k in before if after[k] != before[k]} == {(2023, "a")} and set(after) - set(before) == {(2030, "c")}
    got = {(r.id, r.at.day): r.v for r in L.read_partitioned(spark, base, "id long, year int, venue string, at date, v double, seq int").collect()}
    assert len(got) == 43 and got[2, 1] == 2.0 and got[2, 2] == 6.0 and got[4, 1] == 77.0 and got[None, 1] == 8.0


def test_partition_upsert_that_fails_leaves_the_old_state(spark, tmp_path):
    base = f"{tmp_path}/silver"
    args = (base, ["year", "venue"], ["id"], "at", "seq")
    rows = [(i, 2023, "a", dt.date(2024, 1, 1), 1.0, 0) for i in range(5)]
    L.partition_upsert(_table(spark, rows), *args)
    before = _files(spark, base)
    broken = _table(spark, [(9, 2023, "a", dt.date(2024, 1, 1), 1.0, 0)]).withColumn("v", F.expr("if(id = 9, raise_error('lost'), v)").cast("double"))
    with pytest.raises(Exception, match="lost"):
        L.partition_upsert(broken, *args)
    assert _files(spark, base) == before and spark.read.parquet(base).count() == 5


def test_append_once_over_replays_and_late_rows(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    batches = [
        [(1, "a", at(0)), (1, "a", at(0)), (2, "b", at(5)), (3, None, None)],
        [(1, "a", at(1)), (2, "b", at(5)), (3, None, None), (4, "d", at(700))],
        [(1, "a", at(0)), (5, "e", at(2)), (2, "c", at(5))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "n int, k string, at timestamp_ntz").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = T.read_stream(spark, f"{tmp_path}/in", "n int, k string, at timestamp_ntz")
        T.append_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck", ["n", "k"], "at", ["n"]).awaitTermination()
    out = spark.read.schema("n int, k string, at timestamp_ntz, _day string").parquet(f"{tmp_path}/out")
    want = {r for rows in batches for r in rows}
    assert sorted(map(str, ((r.n, r.k, r.at) for r in out.collect()))) == sorted(map(str, want))
    assert {r._day for r in out.select("_day").distinct().collect()} == {"20240101", "20240130", "none"}


def _alerts(cycles, least, stale, cooldown, end):
    """Second by second."""
    fails, ok_at, last, alerting, out = 0, None, {}, False, []
    by = {at: (ok, bad) for at, ok, bad in cycles}
    for now in range(min(by), end + 1):
        if now in by and by[now][0] > 0:
            if alerting:
                out.append((now, "recovered"))
            fails, ok_at, last, alerting = 0, now, {}, False
            continue
        if now in by:
            fails += by[now][1] > 0
            if fails >= least and now - last.get("failing", -(10**9)) >= cooldown:
                last["failing"], alerting = now, True
                out.append((now, "failing"))
        if now < end and ok_at is not None and now - ok_at >= stale and now - last.get("stale", -(10**9)) >= cooldown:
            last["stale"], alerting = now, True
            out.append((now, "stale"))
    return sorted(out)


def test_watchdog_cycles_and_silence(spark, tmp_path):
    r = random.Random(3)
    start = 1_700_000_000
    cycles = {}
    for source in ("a", "b", "silent"):
        at, rows = start, []
        for _ in range(60):
            at += r.choice([30, 60, 100, 100, 400])
            rows.append((at, r.choice([0, 0, 0, 1]), r.choice([0, 1, 1])))
        cycles[source] = rows if source != "silent" else [(start + 5, 3, 0)]
    end = max(at for rows in cycles.values() for at, _, _ in rows)
    stamp = lambda at: dt.datetime.fromtimestamp(at, dt.timezone.utc).replace(tzinfo=None)
    for lo, hi in ((0, start + 2500), (start + 2500, start + 5000), (start + 5000, 2 * start)):
        rows = [(s, stamp(at), ok, bad) for s, own in cycles.items() for at, ok, bad in own if lo <= at < hi]
        spark.createDataFrame(rows, "source string, at timestamp_ntz, ok long, bad long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = T.read_stream(spark, f"{tmp_path}/in", "source string, at timestamp, ok long, bad long", "parquet")
        found = T.watchdog_stream(stream, "source", "at", "ok", "bad", least=3, stale=300, cooldown=200)
        found.writeStream.option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((x.source, x.s, x.alert) for x in spark.read.parquet(f"{tmp_path}/out").select("source", F.unix_timestamp("at").alias("s"), "alert").collect())
    assert got == sorted((s, at, kind) for s, own in cycles.items() for at, kind in _alerts(own, 3, 300, 200, end))
    assert sum(s == "silent" and kind == "stale" for s, _, kind in got) > 5 and {kind for _, _, kind in got} == {"failing", "stale", "recovered"}
