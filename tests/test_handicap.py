import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parimart.operators import compose as C
from parimart.operators import histories
from parimart.operators import relational as R

ROLES = {
    "horse": ("horse_id",), "trainer": ("trainer_id",), "jockey": ("jockey_id",), "trainer_jockey_combo": ("trainer_id", "jockey_id"), "jockey_track": ("jockey_id", "racecourse"),
}
SCHEMA = """race_id int, runner int, horse_id int, trainer_id string, jockey_id int, race_date timestamp_ntz, available_at timestamp_ntz, racecourse string, surface string,
    going_wetness int, win_odds double, finish_position int, finish_time_seconds double, last_3f_seconds double, body_weight_kg double, race_name string"""


def _starts(n=260, hours=False):
    r = random.Random(n + hours)
    some = lambda x, share=0.06: None if r.random() < share else x
    rows = []
    for race in range(n):
        at = dt.datetime(2018, 1, 1) + dt.timedelta(days=r.randrange(1200), hours=r.randrange(24) if hours else 0)
        day, course, surface, name = some(at, 0.03), some(r.choice("abc")), some(r.choice(["turf", "dirt"])), some(r.choice(["Spring Cup", "Maiden"]))
        for runner in range(r.randrange(1, 6)):
            known = some(at + dt.timedelta(days=r.randrange(90)), 0.04)
            rows.append((
                race, runner, some(r.randrange(14)), some(r.choice("xyz")), some(r.randrange(5)), day, known, course, surface, r.choice([1, 2]), 2.0 + runner,
                some(r.randrange(1, 6)), some(r.randrange(600, 900) / 10), some(r.randrange(330, 400) / 10), some(float(r.randrange(420, 520))), name,
            ))
    return rows


def _expected(rows, guarded):
    names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
    rows = [dict(zip(names, x)) for x in rows]
    bucket = lambda x: (x["racecourse"], x["surface"], x["going_wetness"])
    horse = lambda x: not guarded or (x["horse_id"] is not None and x["horse_id"] != 3)
    out = {}
    for q in rows:
        day = q["race_date"]
        past = [x for x in rows if None not in (day, x["race_date"], x["available_at"]) and x["race_date"] < day and x["available_at"] <= day]
        want = {"field_size": sum(x["race_id"] == q["race_id"] for x in rows), "surface_turf": int(q["surface"] == "turf"), "is_filtered_name_match": int(q["race_name"] == "Spring Cup")}
        for role, keys in ROLES.items():
            own = [x for x in past if None not in [q[k] for k in keys] and all(x[k] == q[k] for k in keys) and day - x["race_date"] <= dt.timedelta(days=365) and (role != "horse" or horse(x))]
            want[f"{role}_starts_365d"] = len(own)
            want[f"{role}_winrate_365d"] = sum(x["finish_position"] == 1 for x in own) / len(own) if own else None
            want[f"{role}_top3rate_365d"] = sum(x["finish_position"] is not None and x["finish_position"] <= 3 for x in own) / len(own) if own else None
        own = [x for x in past if q["horse_id"] is not None and x["horse_id"] == q["horse_id"] and horse(x)]
        for v, name in (("finish_time_seconds", "finish_time_par_delta"), ("last_3f_seconds", "last_3f_par_delta")):
            mine = [x[v] for x in own if x[v] is not None and bucket(x) == bucket(q)]
            par = [x[v] for x in rows if day and x["race_date"] and x["race_date"].year < day.year and x[v] is not None and bucket(x) == bucket(q) and horse(x)]
            want[name] = sum(mine) / len(mine) - float(np.median(par)) if mine and par else None
        last = sorted(own, key=lambda x: (x["race_date"], x["race_id"], x["runner"]), reverse=True)[:10]
        first = last[0] if last else dict.fromkeys(names)
        mean = lambda c: (lambda v: sum(v) / len(v) if v else None)([x[c] for x in last[:5] if x[c] is not None])  # noqa: E731, B023
        want |= {"last_finish_pos": first["finish_position"], "last_finish_time_sec": first["finish_time_seconds"], "last_last_3f_seconds": first["last_3f_seconds"]}
        want |= {"avg_finish_pos_5": mean("finish_position"), "avg_finish_time_sec_5": mean("finish_time_seconds"), "starts_last_10": len(last)}
        want |= {"wins_last_10": sum(x["finish_position"] == 1 for x in last), "days_since_last_race": (day.date() - first["race_date"].date()).days if last else None}
        now, then = q["body_weight_kg"], first["body_weight_kg"]
        out[q["race_id"], q["runner"]] = want | {"body_weight_delta_vs_last": None if None in (now, then) else now - then}
    return out


@pytest.mark.parametrize("guarded,held,hours", [(False, 1 << 16, False), (True, 1 << 16, True), (True, 60, False)])
def test_handicap_features_match_plain_code(spark, monkeypatch, guarded, held, hours):
    monkeypatch.setattr(histories, "HELD", held)
    rows = _starts(hours=hours)
    df = spark.createDataFrame(rows, SCHEMA)
    guard = F.col("horse_id") != 3 if guarded else None
    want = _expected(rows, guarded)
    passing = [c for c in df.columns if c not in ("finish_time_seconds", "last_3f_seconds", "finish_position", "available_at", "win_odds")]
    out = C.handicap_features(df.repartition(5), guard=guard)
    assert out.columns[: len(passing)] == passing and dict(out.dtypes)["race_date"] == "timestamp_ntz" and dict(out.dtypes)["field_size"] == "bigint"
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == {*passing, *next(iter(want.values()))}
    given = {x[:2]: x for x in rows}
    for x in got:
        assert (x.horse_id, x.trainer_id, x.jockey_id, x.race_date) == given[x.race_id, x.runner][2:6]
        for c, v in want[x.race_id, x.runner].items():
            assert x[c] == (v if v is None else pytest.approx(v, abs=1e-9)), (c, x)


def test_handicap_rows_meet_three_times(spark):
    df = spark.createDataFrame(_starts(40), SCHEMA)
    few = C.handicap_features(df, keep=["racecourse"])
    assert few.columns[:4] == ["race_id", "runner", "racecourse", "last_finish_pos"]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    # The two windows number the buckets.
    assert plan.count("RepartitionByExpression") == 3 and plan.count("Window [") == 2 and "Aggregate [" not in plan and "Union" not in plan
    # What isn't kept stays behind, and what only the first meetings need goes no further.
    moves = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert len(moves) == 3 and not [x for x in moves if "race_name" in x] and "trainer_id" not in moves[0] and "jockey_id" not in moves[0]
    with pytest.raises(ValueError, match="market"):
        C.handicap_features(df, keep=["win_odds"])
    assert C.handicap_features(df.limit(0)).count() == 0


def test_medians_order_only_the_middle_chunks(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i % 3, 2000 + i % 5, r.gauss(0, 9)) for i in range(9000)]
    df = spark.createDataFrame(rows, "k int, y int, v double")
    seen = []
    real = R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    monkeypatch.setattr(R, "running_sum", None)  # all values are put in order no more
    got = {(x.k, x.y): x["median"] for x in R.growing_median(df, ["k"], "y", "v", chunk=64).collect()}
    assert got == {(k, y): float(np.median([v for a, b, v in rows if a == k and b < y])) for k in range(3) for y in range(2001, 2005)}
    assert [n for n, _ in seen] == ["middle"] and 12 <= seen[0][1].count() <= 24


def test_only_long_entities_are_counted_by_key(spark, monkeypatch):
    monkeypatch.setattr(histories, "HELD", 50)
    df = spark.createDataFrame([(i % 7 if i < 200 else 9 + i % 2, "a") for i in range(400)] + [(None, "a")] * 90, "k int, g string")
    assert sorted(x.k for x in histories.long_entities(df, ["k", "g"]).collect()) == [9, 10]
    assert histories.long_entities(df.where("k < 9"), ["k"]) is None and histories.long_entities(df.where("k is null"), ["k"]) is None
