"""Invariants and hand-computed values of market, ordering and settlement operators."""

import math

import pytest
from pyspark.sql import functions as F

from parimart.operators import compose
from parimart.operators import market as M
from parimart.operators import ordering as O
from parimart.operators import relational as R
from parimart.operators import settlement as S


@pytest.fixture(scope="module")
def field(spark):
    odds = [2.0, 4.0, 8.0, 9.0, 15.0, 30.0]
    return M.devig(spark.createDataFrame([("r", i + 1, o) for i, o in enumerate(odds)], "race_id string, runner int, win_odds double"), ["race_id"], "win_odds")


def test_devig_of_three(spark):
    df = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 4.0), ("r", 3, 8.0), ("r", 4, None), ("r", 5, 0.0)], "g string, i int, o double")
    got = [r.p for r in M.devig(df, ["g"], "o").orderBy("i").collect()]
    assert got[:3] == pytest.approx([4 / 7, 2 / 7, 1 / 7]) and got[3:] == [None, None]


@pytest.mark.parametrize("pool,total", [("exacta", 1), ("quinella", 1), ("trifecta", 1), ("trio", 1), ("wide", 3), ("place", 3)])
def test_pools_sum(field, pool, total):
    assert O.combos(field, "race_id", "runner", "p", pool).agg(F.sum("prob")).first()[0] == pytest.approx(total)


def test_gamma_one_is_harville(field):
    p = {r.runner: r.p for r in field.collect()}
    row = O.sequences(field, "race_id", "runner", "p", 3, 1.0).where("a = 1 and b = 3 and c = 2").first()
    assert row.prob == pytest.approx(p[1] * p[3] / (1 - p[1]) * p[2] / (1 - p[1] - p[3]))


def test_softmax_sums_to_one(field):
    got = field.select("race_id", M.softmax("win_odds", ["race_id"]).alias("s")).agg(F.sum("s")).first()[0]
    assert got == pytest.approx(1)


def test_asof_never_looks_ahead(spark):
    snaps = spark.createDataFrame([("r", 1, 10, 10.0), ("r", 1, 20, 8.0), ("r", 1, 30, 6.0), ("r", 1, 55, 1.5)], "g string, i int, t int, o double")
    q = spark.createDataFrame([("r", 1, 50), ("r", 1, 9), ("r", 2, 50), ("r", 1, None)], "g string, i int, at int")
    got = {(r.i, r.at): r.o for r in R.asof_join(q, snaps, ["g", "i"], "at", "t", ["o"]).collect()}
    assert got == {(1, 50): 6.0, (1, 9): None, (2, 50): None, (1, None): None}


def test_drift_needs_a_field(spark):
    rows = [("r", i, 10.0, 10.0) for i in range(5)] + [("r", 5, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "g string, i int, now double, op double")
    flags = {r.i: r.direction for r in M.residual_drift(df, ["g"], "now", "op").collect()}
    assert flags[5] == "firming" and all(v is None for k, v in flags.items() if k != 5)
    few = M.residual_drift(df.where("i > 1"), ["g"], "now", "op")
    assert few.where("direction is not null").isEmpty()


def test_settlement(spark):
    bets = spark.createDataFrame([("r", "win", "01", 100), ("r", "win", "02", 100), ("r", "win", "03", 200), ("r", "exacta", "0102", 100)], "race_id string, pool string, combo string, stake int")
    pays = spark.createDataFrame([("r", "win", "01", 600), ("r", "win", "01", 500)], "race_id string, pool string, combo string, payout_yen int")
    starters = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "race_id string, runner int")
    got = {r.combo: (r.payout, r.refund, r.reason) for r in S.settle_bets(bets, pays, starters, starters.where("runner < 3")).collect()}
    assert got == {"01": (600, 0, "official_payout"), "02": (0, 0, "loss"), "03": (0, 200, "refund"), "0102": (0, 0, "loss")}


def test_dead_heat_orders(spark):
    pl = spark.createDataFrame([("r", 1, 4), ("r", 2, 7), ("r", 2, 9), ("r", 3, 1)], "race_id string, position int, runner int")
    assert sorted(tuple(r.order) for r in S.expand_placings(pl).collect()) == [(4, 7, 1), (4, 9, 1)]


def test_bracket_selection_keeps_one_digit(spark):
    df = spark.createDataFrame([("3-8", "bracket_quinella"), ("1-8", "quinella"), ("0208", "quinella"), ("7", "win")], "s string, p string")
    got = [r[0] for r in df.select(S.normalize_selection(F.col("s"), F.col("p"))).collect()]
    assert got == ["38", "0108", "0208", "07"]


def test_gamma_recovers_default_without_history(spark):
    curves = spark.createDataFrame([(f"r{i}", g, -abs(g - 0.8)) for i in range(6) for g in (0.6, 0.8, 1.0)], "race string, gamma double, ll double")
    got = {r.race: r.gamma for r in O.fit_gamma_walkforward(curves, ["race"], "race", window=3).collect()}
    assert got == {"r0": 1.0, "r1": 1.0, "r2": 1.0, "r3": 0.8, "r4": 0.8, "r5": 0.8}


def test_gamma_windows_equal_brute_force(spark):
    ll = {(i, g): float((i * 7 + int(10 * g) * (i % 5)) % 13) for i in range(47) for g in (0.6, 0.8, 1.0)}
    curves = spark.createDataFrame([(i, g, v) for (i, g), v in ll.items()], "race int, gamma double, ll double")
    got = {r.race: r.gamma for r in O.fit_gamma_walkforward(curves, ["race"], "race", window=5).collect()}
    for i in range(47):
        past = {g: sum(ll[k, g] for k in range(i - 5, i)) for g in (0.6, 0.8, 1.0)} if i >= 5 else {1.0: 0.0}
        assert got[i] == min(past, key=lambda g: (-past[g], g))


def test_entropy_of_even_field(spark):
    df = spark.createDataFrame([("r", i, 4.0) for i in range(4)], "g string, i int, o double")
    assert M.snapshot_market(df, ["g"], "o", "i").first().market_entropy == pytest.approx(math.log(4))


def test_sweep_passes_and_kinds(spark):
    tickets = spark.createDataFrame(
        [(1, 1, "open", None, None), (2, 1, "won", 500.0, "old"), (3, 1, "won", 300.0, "new"), (4, 1, "miss", None, "old"), (5, 2, "open", None, None), (6, 2, "won", 1.0, "old"), (7, 3, "open", None, None), (8, 1, "miss", None, None)],
        "ticket_id int, race_id int, state string, returned double, seen_hash string",
    )
    new = spark.createDataFrame([(1, "won", 200.0), (2, "won", 400.0), (3, "won", 1.0), (4, "won", 9.0), (5, "miss", None), (6, "miss", None), (7, "open", None), (8, "miss", None)], "ticket_id int, state string, returned double")
    stored = spark.createDataFrame([(1, "new")], "race_id int, hash string")
    got = [(r.ticket_id, r.source, r.kind) for r in compose.settle_sweep(tickets, new, stored, 10, archived=new).collect()]
    assert got == [(1, "snapshot", "settled"), (2, "snapshot", "amount"), (4, "snapshot", "state"), (8, "snapshot", "hash"), (5, "archive", "settled")]
    assert [r.ticket_id for r in compose.settle_sweep(tickets, new, stored, 2, archived=new).collect()] == [1, 2]
    assert len(compose.settle_sweep(tickets, new, stored, 10).collect()) == 4


def test_lines_are_unfolded_in_tasks(spark):
    """Against plain loops: items twice in a group, chances of 0, groups longer than a batch, exponents by group."""
    import itertools

    rows = [(g, i, p) for g, n in ((1, 5), (2, 2), (3, 1), (4, 6)) for i, p in zip(range(n), [0.4, 0.25, 0.15, 0.1, 0.06, 0.04])]
    rows += [(1, 2, 0.05), (4, 9, 0.0), (None, 1, 0.5), (None, 2, 0.5), (5, None, 0.5), (5, 1, 0.25), (5, 3, 0.25)]
    df = spark.createDataFrame(rows, "race int, runner int, p double").withColumn("gamma", F.when(F.col("race") == 1, 0.8).otherwise(1.1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for pool, places, together in (("exacta", 2, False), ("quinella", 2, True), ("trifecta", 3, False), ("trio", 3, True)):
            made = O.combos(df, "race", "runner", "p", pool, F.col("gamma"))
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1
            got, want = {}, {}
            for x in made.collect():
                got.setdefault((x[0], *x[1 : 1 + places]), []).append(x[-1])
            for g in (1, 2, 3, 4, 5):
                own, e = [(i, p) for r, i, p in rows if r == g and i is not None and p > 0], 0.8 if g == 1 else 1.1
                for line in itertools.permutations(own, places):
                    if len({i for i, _ in line}) < places:
                        continue
                    prob, left = line[0][1] / sum(p for _, p in own), sum(p**e for _, p in own)
                    for (_, last), (_, p) in itertools.pairwise(line):
                        left -= last**e
                        prob *= p**e / left
                    key = [i for i, _ in line]
                    want.setdefault((g, *(sorted(key) if together else key)), []).append(prob)
            want = {k: [sum(v)] if together else sorted(v) for k, v in want.items()}
            assert {k: sorted(v) for k, v in got.items()} == {k: pytest.approx(v) for k, v in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bracket_pairs_move_once(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.2), (2, 1, 0.6), (2, 4, 0.4)], "race int, runner int, p double")
    gates = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 1)], "race int, item int, bracket int")  # one without a gate
    pairs = O.combos(df, "race", "runner", "p", "quinella", 1.0)
    made = O.bracket_pairs(pairs, gates, "race")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    own = {(x.race, x.a, x.b): x.prob for x in pairs.collect()}
    got = {(x.race, x.lo, x.hi): (x.points, x.prob) for x in made.collect()}
    assert got == {(1, 1, 1): (1, pytest.approx(own[1, 1, 2])), (1, 1, 2): (2, pytest.approx(own[1, 1, 3] + own[1, 2, 3]))}


def test_formation_and_structure_move_once(spark):
    sets = [(1, p, i) for p in (0, 1) for i in (3, 1, 2)] + [(2, 0, 1), (2, 1, 2), (2, 1, 3), (2, 1, 1), (3, 0, 1), (3, 1, 1), (None, 0, 1), (None, 1, 2), (4, 0, None), (4, 1, 2)]
    df = spark.createDataFrame(sets, "ticket int, place int, item int")
    lines = O.formation(df, "ticket", 2, ordered=False)
    assert sorted(map(tuple, lines.collect())) == [(1, 1, 2), (1, 1, 3), (1, 2, 3), (2, 1, 2), (2, 1, 3)]
    assert sorted(map(tuple, O.formation(df, "ticket", 2, ordered=True).where("ticket = 1").collect())) == [(1, a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]
    made = O.classify_structure(lines, "ticket", 2, ordered=False)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [(1, 3, 3, "box"), (2, 3, 2, "custom")]
    assert O.classify_structure(lines.unionByName(lines), "ticket", 2, ordered=False).where("structure = 'box'").isEmpty()
