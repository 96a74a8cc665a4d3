"""Leakage guards, scalar parsing, walk-forward fits and evaluation."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parimart.functions import scalars as X
from parimart.operators import compose as C
from parimart.operators import evaluate as K
from parimart.operators import features as H
from parimart.operators import relational as R
from parimart.operators import trees


def test_leakage_raises(spark):
    df = spark.createDataFrame([(1, 2), (5, 4)], "source int, as_of int")
    with pytest.raises(H.LeakageError):
        H.assert_point_in_time(df, "source", "as_of")
    assert H.assert_point_in_time(df, "source", "as_of", drop=True).count() == 1
    with pytest.raises(ValueError):
        H.assert_market_blind(df.withColumn("Win_Odds", F.lit(1)), ["win_odds"])


def test_parse_time_and_names(spark):
    df = spark.createDataFrame([("2024-05-01T10:00:00", " ＡＢ c "), ("20240501100000", ""), ("20240501", None), ("x", "é")], "t string, n string")
    got = [tuple(r) for r in df.select(X.parse_time(F.col("t")), X.normalize_name(F.col("n"))).collect()]
    ten = dt.datetime(2024, 5, 1, 10)
    assert got == [(ten, "ABc"), (ten, None), (dt.datetime(2024, 5, 1), None), (None, "é")]


def test_as_of_without_zone_is_japanese(spark):
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("2024-05-01T10:00:00",), ("2024-05-01T10:00:00Z",), ("soon",)], "t string")
    got = [r[0] for r in df.select(F.date_format(X.parse_as_of(F.col("t"), now), "yyyy-MM-dd HH")).collect()]
    assert got == ["2024-05-01 01", "2024-05-01 10", "2020-01-01 00"]


def test_beta_walkforward_schedule(spark):
    n = 60
    races = spark.createDataFrame([(i, i, i) for i in range(n)], "race int, as_of int, known int")
    losses = spark.createDataFrame([(i, b, abs(b - (1.5 if i < 30 else 0.5))) for i in range(n) for b in (0.5, 1.0, 1.5)], "race int, beta double, loss double")
    got = {r.race: (r.n_history, r.beta) for r in H.fit_beta_walkforward(losses, races, "race", "as_of", "known", first=10, window=20, every=15).collect()}
    assert got[5] == (6, 1.0) and got[9] == (10, 1.5) and got[23] == (24, 1.5)
    assert got[59][1] == 0.5


def test_market_probs_match_a_plain_walk(spark):
    r, races, rows = random.Random(4), [], []
    for i in range(70):
        odds = [round(r.uniform(1.5, 30), 1) for _ in range(r.choice([2, 5, 8]))]
        winner, as_of = r.choices(range(len(odds)), [1 / o**1.4 for o in odds])[0], r.randrange(90)
        races.append((i, as_of, None if i % 11 == 5 else as_of + r.randrange(1, 15), odds, winner))
        rows += [(i, k, o, 1 if k == winner else 2, as_of, races[-1][2]) for k, o in enumerate(odds)]
    grid, first, window, every = [0.6, 0.8, 1.0, 1.2, 1.4], 8, 20, 6
    df = spark.createDataFrame(rows, "race int, item int, odds double, position int, as_of int, known int").repartition(3)
    got = {(x.race, x["item"]): x for x in C.market_probs(df, "race", "item", "odds", "position", "as_of", "known", grid, first=first, window=window, every=every).collect()}
    assert len(got) == len(rows)
    p = {i: [1 / o / sum(1 / x for x in odds) for o in odds] for i, _, _, odds, _ in races}
    powered = lambda i, b: [x**b / sum(y**b for y in p[i]) for x in p[i]]
    order = [i for i, _, known, _, _ in sorted((x for x in races if x[2] is not None), key=lambda x: (x[2], x[0]))]
    size = {i: sum(k is not None and k <= t for _, _, k, _, _ in races) for i, t, _, _, _ in races}
    fit, last = {}, 0
    for n in sorted(set(size.values())):
        if n >= first and (last < first or n - last >= every):
            last = n
        past = order[max(0, last - window) : last]
        fit[n] = min(grid, key=lambda b: (round(sum(-math.log(powered(i, b)[races[i][4]]) for i in past) / len(past), 12), b)) if past else 1.0
    assert len(set(fit.values())) > 2
    for i, _, _, odds, _ in races:
        for k in range(len(odds)):
            x = got[i, k]
            assert x.market_beta == fit[size[i]] and x.p == pytest.approx(p[i][k]) and x.calibrated_market_prob == pytest.approx(powered(i, fit[size[i]])[k])


def test_logit_probs_match_newton_steps(spark):
    g = np.random.default_rng(8)
    x = g.normal(size=(600, 2)) * [1, 5]
    y = (g.random(600) < 1 / (1 + np.exp(1.5 - x[:, 0] + 0.1 * x[:, 1]))).astype(float)
    df = spark.createDataFrame([(i, i // 6, *map(float, x[i]), float(y[i])) for i in range(600)], "i int, race int, a double, b double, y double")
    train, test = df.where("race < 60"), df.where("race >= 60")
    got = {r.i: r.model_prob for r in K.fit_logit_probs(train, test, ["a", "b"], "y", ["race"]).collect()}
    design, of = np.c_[np.ones(600), x], y[:360]
    weight, w = np.where(of == 1, 0.5 / of.mean(), 0.5 / (1 - of.mean())), np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-design[:360] @ w))
        w += np.linalg.solve((design[:360].T * (weight * q * (1 - q))) @ design[:360], design[:360].T @ (weight * (of - q)))
    plain = 1 / (1 + np.exp(-design[360:] @ w)).reshape(-1, 6)
    plain = (plain / plain.sum(axis=1, keepdims=True)).ravel()
    assert sorted(got) == list(range(360, 600)) and max(abs(got[360 + i] - v) for i, v in enumerate(plain)) < 1e-4


def test_bins_conventions(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.5,), (1.0,)], "p double")
    right = [r[0] for r in df.select(K.binned(F.col("p"), [0, 0.1, 0.5, 1.0])).collect()]
    left = [r[0] for r in df.select(K.binned(F.col("p"), [0, 0.1, 0.5, 1.0], "left")).collect()]
    assert right == [None, 0, 1, 2] and left == [0, 1, 2, 2]


def test_bootstrap_interval_holds_the_point(spark):
    df = spark.createDataFrame([(i % 40, float(i % 7), 1.0) for i in range(2000)], "day int, a double, b double")
    r = K.cluster_bootstrap(df, "day", "a", "b", 200).first()
    assert r.lo < r.point < r.hi


def test_conditional_logit_recovers_sign(spark):
    rows = [(r, i, float(i), i == 2) for r in range(60) for i in range(3)]
    df = spark.createDataFrame(rows, "race int, runner int, x double, won boolean")
    assert K.fit_conditional_logit(df, "race", ["x"], F.col("won"))[0] == 5.0  # the winner always has the largest: at its bound


def test_conditional_logit_is_where_the_plain_gradient_is_zero(spark):
    g = np.random.default_rng(3)
    rows = []
    for r in range(300):
        x = g.normal(size=(4, 2))
        p = np.exp(x @ [0.8, -0.4])
        w = g.choice(4, p=p / p.sum())
        rows += [(r, float(x[i, 0]), float(x[i, 1]), bool(i == w)) for i in range(4)]
    rows += [(300, 0.5, 0.5, False), (300, 1.5, 0.5, False), (301, None, float("nan"), True), (301, 1.0, 0.0, False)]
    df = spark.createDataFrame(rows, "race int, a double, b double, won boolean")
    got = np.array(K.fit_conditional_logit(df, "race", ["a", "b"], F.col("won"), tolerance=1e-9))
    known = np.array([r[1:3] for r in rows if r[1] is not None])
    fill, slope = np.median(known, axis=0), 2 * 0.01 * got
    for r in set(r[0] for r in rows) - {300}:
        x = np.array([fill if a is None else (a, b) for k, a, b, _ in rows if k == r])
        p = np.exp(x @ got)
        slope += p @ x / p.sum() - x[[w for k, _, _, w in rows if k == r].index(True)]
    assert np.abs(slope).max() < 1e-5 and got[0] > 0.5 and got[1] < -0.2
    assert K.fit_conditional_logit(df.limit(0), "race", ["a", "b"], F.col("won")) == [0.0, 0.0]


def test_validation_of_features(spark):
    g = np.random.default_rng(5)
    rows = []
    for r in range(200):
        x = g.normal(size=4)
        p = np.exp(1.5 * x) / np.exp(1.5 * x).sum()
        w = g.choice(4, p=p)
        rows += [(r, dt.date(2021 + r // 50, 1, 1) + dt.timedelta(r % 50), 0.25, float(x[i]) if r else None, 4.0, bool(i == w)) for i in range(4)]
    df = spark.createDataFrame(rows, "race int, d date, p double, x double, odds double, won boolean").withColumn("lp", F.ln("p"))
    got = C.validate_features(df, "race", "d", "p", ["lp"], ["x_z"], "odds", F.col("won"), z=["x"]).first()
    # 100 races in each era: 30 of either are tests. The even field's loss is that of chance.
    assert (got.races, got.runners) == (60, 240) and abs(got.baseline_log_loss - np.log(4)) < 1e-6
    assert got.enhanced_log_loss < got.baseline_log_loss - 0.1
    assert 60 <= got.stakes < 70 and got.roi == pytest.approx(4 * got.hit_rate - 1) and got.hit_rate > 0.4
    assert got.subset == "all" and got.delta_log_loss == pytest.approx(got.enhanced_log_loss - got.baseline_log_loss) and got.verdict == "edge"
    assert got.delta_lo < got.delta_log_loss < got.delta_hi < 0 and got.roi_lo < got.roi < got.roi_hi
    parts = {"low": F.col("race") % 2 == 0, "none": F.col("race") < 0, "few": F.col("race") == 199, "all": F.lit(True)}
    by = {r.subset: r for r in C.validate_features(df, "race", "d", "p", ["lp"], ["x_z"], "odds", F.col("won"), z=["x"], subsets=parts, draws=50).collect()}
    assert set(by) == {"low", "all"} and by["low"].runners == 120 and by["all"].stakes == got.stakes and by["all"].delta_log_loss == pytest.approx(got.delta_log_loss)
    assert by["low"].stakes < got.stakes and by["low"].delta_lo <= by["low"].delta_log_loss <= by["low"].delta_hi


def test_ticket_styles_match_plain_scores(spark):
    probs = [(1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.2), (1, 4, 0.0), (1, 5, None), (2, 1, 0.6), (2, 2, 0.4), (3, 1, 0.5), (3, 2, 0.5)]
    marks = [(1, 3, "like"), (1, 3, "like"), (1, 2, "distrust"), (2, 1, "avoid"), (3, 7, "anchor"), (1, 1, None), (9, None, "anchor")]
    lines = [(1, 1, 2, 0.3), (1, 1, 3, 0.2), (1, 3, 4, 0.05), (1, 1, 2, 0.3), (2, 1, 2, 1.0), (3, 1, 2, 1.0), (4, 1, 2, 0.5), (1, 2, 3, 0.0), (1, 2, 3, None)]
    got = C.score_styles(
        spark.createDataFrame(lines, "race int, a int, b int, prob double"), spark.createDataFrame(probs, "race int, item int, p double"),
        spark.createDataFrame(marks, "race int, item int, mark string"), [("s", "safe", "chalk"), ("e", "balanced", ""), ("x", "antiChalk", "value")],
        "race", "item", "p", ["a", "b"],
    ).collect()
    found = {}
    for r in got:
        found.setdefault((r.race, r.a, r.b, r.style), []).append((r.tag, r.score))
    # Race 2 has its pair avoided, race 3 an anchor that is in none; race 4 has no market.
    assert {k[:3] for k in found} == {(1, 1, 2), (1, 1, 3), (1, 3, 4), (4, 1, 2)} and len(found[1, 1, 2, "s"]) == 2
    log = lambda q: math.log(1 / q)
    want = {
        (1, 1, 2, "s"): ("chalk", 0.3 * 7 + log(0.3) * 0.08 - 0.3 + 0.4 * 0.32), (1, 1, 2, "e"): ("chalk", 0.3 * 4 + log(0.3) * 0.35 - 0.3 - 0.25 - 0.3),
        (1, 1, 2, "x"): ("chalk", 0.3 * 4 + log(0.3) * 0.35 - 0.3 - 0.25 - 0.55 + 0.6 * 0.32), (1, 1, 3, "e"): ("blend", 0.2 * 4 + log(0.2) * 0.35 + 0.25 + 0.45),
        (1, 3, 4, "x"): ("value", 0.05 * 4 + log(0.05) * 0.35 + 0.25 + 0.9 * 0.32), (4, 1, 2, "s"): ("value", 0.5 * 7 + log(0.5) * 0.08),
    }
    for k, (tag, score) in want.items():
        assert found[k][0][0] == tag and found[k][0][1] == pytest.approx(score), k


def test_running_sum_over_ranges(spark):
    rows = [(37 * i % 1000, i % 5) for i in range(1000)]
    got = {r.k: r.s for r in R.running_sum(spark.createDataFrame(rows, "k int, v int"), ["k"], F.col("v"), "s").collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want


def test_classifier_by_year(spark):
    rows = [(y, float(i % 5) if i % 11 else None, float(i % 5 > 2)) for y in (2020, 2021, 2022) for i in range(60)]
    out = K.fit_classifier_walkforward(spark.createDataFrame(rows, "y int, x double, won double"), "y", ["x"], "won", maxIter=3)
    assert out.count() == 120 and out.where("y = 2020").isEmpty()


def test_registered_fits_use_the_whole_grids(spark, monkeypatch):
    import __spark_entry__ as entry
    from parimart.operators import evaluate, ordering

    sf, q = "/root/testdata/sf0.001", entry.queries()
    assert [r.n for r in q["H3_beta_losses_whole"](spark, sf).groupBy("race_id").count().selectExpr("count as n").distinct().collect()] == [56]
    assert q["K20_blend_grid_whole"](spark, sf).selectExpr("count(distinct w0) as n", "max(w0) as m").first()[:] == (81, 2.0)
    assert 0.5 <= q["J6_gamma_global_whole"](spark, sf).first().gamma <= 1.0
    seen = {}

    def spy(module, name, arg):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: seen.setdefault(name, []).append(k.get(arg, a[arg] if isinstance(arg, int) else None)) or real(*a, **k))

    spy(H, "beta_losses", 4)
    spy(ordering, "fit_gamma_walkforward", "window")
    spy(ordering, "gamma_likelihood", "places")
    spy(evaluate, "bootstrap_draws", 2)
    spy(evaluate, "blend_losses", 4)
    monkeypatch.setattr(evaluate, "fit_classifier_walkforward", lambda *a, **k: seen.update(trees=k["maxIter"]))
    for name in ("H3_beta_walkforward", "H2_market_probs", "J5_gamma_walkforward_whole", "K12_cluster_bootstrap", "K21_bootstrap_blend", "K18_walkforward_classifier"):
        q[name](spark, sf)
    assert [len(g) for g in seen["beta_losses"]] == [56, 56] and [len(g) for g in seen["blend_losses"]] == [81]
    assert seen["fit_gamma_walkforward"] == [1000] and seen["gamma_likelihood"] == [3] and seen["bootstrap_draws"] == [500, 500] and seen["trees"] == 200


def test_recent_form_counts_only_known_runs(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    # Twelve runs ten days apart, each known five days later; the last of them only long after the race.
    runs = [("a", i, day(10 * i), day(10 * i + (500 if i == 11 else 5)), 1 if i % 2 else 4, 60.0 + i) for i in range(12)]
    history = spark.createDataFrame([*runs, (None, 0, day(1), day(1), 1, 50.0)], "horse string, race int, d date, known date, place int, time double")
    target = spark.createDataFrame([("a", day(120)), ("a", day(0)), ("b", day(120)), (None, day(120))], "horse string, d date").withColumn("as_of", F.col("d"))
    form = H.recent_form(target, history, "horse", "d", "known", "as_of", "place", "time", ties=("race",))
    got = {(r.horse, r.d): r for r in form.collect()}
    a = got["a", day(120)]
    assert (a.last_finish_pos, a.last_finish_time_sec, a.days_since_last_race) == (4, 70.0, 20)
    assert (a.avg_finish_time_sec_5, a.wins_last_10, a.starts_last_10) == (68.0, 5, 10)
    for key in (("a", day(0)), ("b", day(120)), (None, day(120))):
        assert (got[key].last_finish_pos, got[key].starts_last_10, got[key].wins_last_10) == (None, 0, 0)
    assert H.recent_form(target.limit(0), history, "horse", "d", "known", "as_of", "place", "time").count() == 0


def test_history_over_periods_equals_brute_force(spark):
    day = lambda n: dt.date(1968, 1, 1) + dt.timedelta(n)
    rows = [("xyz"[i % 3], day(37 * i % 1500), day(37 * i % 1500 + i % 40), i % 6 + 1) for i in range(240)]
    df = spark.createDataFrame(rows, "jockey string, d date, known date, place int").withColumn("as_of", F.col("d"))
    got = H.trailing_rates(df, df, ["jockey"], "d", "known", "as_of", "place", 365, "j").collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [p for j, d, k, p in rows if j == r.jockey and d < r.d and k <= r.d and (r.d - d).days <= 365]
        assert (r.j_starts, r.j_wins, r.j_top3) == (len(mine), sum(p == 1 for p in mine), sum(p <= 3 for p in mine))


def test_par_delta_by_bucket(spark):
    d = dt.date
    rows = [("a", "x", d(2022, 5, 1), 60.0), ("b", "x", d(2022, 6, 1), 64.0), ("a", None, d(2022, 7, 1), 90.0), ("a", "x", d(2023, 5, 1), 58.0), ("a", None, d(2023, 6, 1), 80.0), ("b", "y", d(2023, 7, 1), None)]
    df = spark.createDataFrame(rows, "horse string, course string, d date, time double").withColumns({"known": F.col("d"), "as_of": F.col("d")})
    out = H.bucket_par_delta(df, df, "horse", ["course"], "d", "known", "as_of", "time", "delta")
    got = {(r.horse, r.d): r.delta for r in out.collect()}
    assert got["a", d(2023, 5, 1)] == 60.0 - 62.0 and got["a", d(2023, 6, 1)] == 0.0
    assert [k for k, v in got.items() if v is not None] and sum(v is None for v in got.values()) == 4


@pytest.mark.parametrize("days,group", [(None, ()), (40, ()), (None, ("venue",)), (3, ("venue",))])
def test_prior_history_matches_all_pairs(spark, days, group):
    r = random.Random(days or 1)
    day = lambda n: dt.date(2001, 1, 1) + dt.timedelta(days=n)
    some = lambda x: None if r.random() < 0.05 else x
    history = [(some(r.choice([1, 1, 1, 2, 3])), some(r.choice("ab")), some(day(d := r.randrange(120))), some(day(d + r.randrange(9))), r.randrange(50)) for _ in range(700)]
    target = [(i, some(r.choice([1, 2, 3, 4])), some(r.choice("ab")), some(day(d := r.randrange(130))), some(day(d + r.randrange(-3, 9)))) for i in range(300)]
    h = spark.createDataFrame(history, "horse long, venue string, date date, seen date, v long")
    t = spark.createDataFrame(target, "i int, horse long, venue string, date date, as_of date")
    got = R.prior_history(t, h, "horse", "date", "seen", "as_of", {"n": F.lit(1), "v": F.col("v")}, days=days, guard=F.col("horse") != 3, group=group)
    assert got.columns == ["i", "horse", "venue", "date", "as_of", "n", "v"]
    for x in got.collect():
        own = [
            row[4] for row in history
            if None not in (row[0], row[2], row[3], x.horse, x.date, x.as_of) and row[0] == x.horse != 3 and row[2] < x.date and row[3] <= x.as_of
            and (days is None or row[2] >= x.date - dt.timedelta(days=days)) and (not group or (x.venue is not None and row[1] == x.venue))
        ]
        assert (x.n, x.v) == (len(own), sum(own))
    assert R.prior_history(t, h.limit(0), "horse", "date", "seen", "as_of", {"n": F.lit(1)}).agg(F.sum("n")).first()[0] == 0


def _plain_boost(rows, bins, prior_rows, rounds, rate, l2, least):
    """Depth-two boosting of one year's model, row by row; ``bins`` are filled. Returns margins of ``rows``."""
    y = np.array([r for r in prior_rows])
    train, every = bins[: len(y)], bins
    p0 = min(max(y.mean(), 1e-6), 1 - 1e-6)
    z = np.full(len(every), math.log(p0 / (1 - p0)))
    score = lambda g, h: g * g / (h + l2)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z[: len(y)]))
        g, h = y - q, q * (1 - q)

        def best(mask):
            found = (1e-9, None)
            for j in range(train.shape[1]):
                for cut in range(int(train[:, j].max()) + 1):
                    a, b = mask & (train[:, j] <= cut), mask & (train[:, j] > cut)
                    if a.sum() >= least and b.sum() >= least:
                        gain = score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[mask].sum(), h[mask].sum())
                        if round(gain, 9) > found[0]:
                            found = (round(gain, 9), (j, cut))
            return found[1]

        def sides(x, split):
            return np.zeros(len(x), bool) if split is None else x[:, split[0]] > split[1]

        step = np.zeros(len(every))
        top = best(np.ones(len(y), bool))
        for right in (False, True):
            own, there = sides(train, top) == right, sides(every, top) == right
            if not own.any():
                continue
            split = best(own)
            for far in (False, True):
                leaf, at = own & (sides(train, split) == far), there & (sides(every, split) == far)
                step[at] = rate * g[leaf].sum() / (h[leaf].sum() + l2)
        z += step
    return z


@pytest.mark.parametrize("held", [0, trees.HELD])
def test_walkforward_trees_match_plain_boosting(spark, held):
    r = random.Random(11)
    rows = []
    for i in range(900):
        a, b = r.choice([None, float("nan"), *[round(r.gauss(0, 1), 1)] * 8]), float(r.randrange(4))
        won = float(r.random() < (0.7 if (a is not None and a == a and a > 0.3) != (b > 1) else 0.2))
        rows.append((i, r.choice([2001, 2002, 2003, 2004]), a, b, won))
    rows += [(900, None, 1.0, 1.0, 1.0), (901, 2003, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, y int, a double, b double, won double")
    model = trees.fit_walkforward(df, "y", ["a", "b"], "won", rounds=12, bins=8, store=5, least=10, held=held)
    got = {x.i: x.score for x in trees.score_walkforward(df, "y", model).collect()}
    assert set(got) == {x[0] for x in rows if x[1] in (2002, 2003, 2004)}
    for k, year in enumerate(model.years):
        past = [x for x in rows if x[1] is not None and x[4] is not None and x[1] < year]
        now = [x for x in rows if x[1] == year]

        def binned(x):
            return [k2 if v is None or v != v else sum(v > e for e in edges) for v, edges, k2 in zip(x[2:4], model.edges, middle)]

        middle = []
        for j in (0, 1):
            own = sorted(sum(x[2 + j] > e for e in model.edges[j]) for x in past if x[2 + j] is not None and x[2 + j] == x[2 + j])
            middle.append(own[(len(own) - 1) // 2] if own else 0)
        assert model.middle[k].tolist() == middle
        z = _plain_boost(now, np.array([binned(x) for x in past + now]), [x[4] for x in past], 12, trees.RATE, trees.L2, 10)[len(past) :]
        assert max(abs(got[x[0]] - 1 / (1 + math.exp(-v))) for x, v in zip(now, z, strict=True)) < 1e-9
    used = {(x.year, x.feature): x for x in trees.importances(spark, model).collect()}
    assert all(used[y, f].splits > 0 and used[y, f].gain > 0 for y in (2003, 2004) for f in "ab")
    out = K.fit_classifier_walkforward(df, "y", ["a", "b"], "won", maxIter=2)
    assert out.columns == ["i", "y", "a", "b", "won", "score", "splits_a", "splits_b"]
    assert K.fit_classifier_walkforward(df.limit(0), "y", ["a", "b"], "won").isEmpty() and K.fit_classifier_walkforward(df.where("y = 2001"), "y", ["a", "b"], "won").isEmpty()


def test_folded_groups_are_longer_than_a_batch(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice(["a", None]), i, r.randrange(100)) for i in range(2000)] + [(9, "z", 0, 5)]
    df = spark.createDataFrame(rows, "k long, s string, i long, v long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = C.fold_groups(
            df, ["k", "s"], ["i"], lambda: (0, [], 0), lambda st, f: (st[0] + f.v.sum(), [*st[1], f.i.iloc[0]][-1:], max(st[2], len(f))),
            lambda key, st: pd.DataFrame({"k": [None if key[0] != key[0] else key[0]], "s": [key[1]], "total": [st[0]], "last": [st[1][0]], "most": [st[2]]}),
            "k long, s string, total long, last long, most long",
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for k, s, _, v in rows:
        groups.setdefault((k, s), []).append(v)
    assert {(x.k, x.s): x.total for x in out} == {g: sum(v) for g, v in groups.items()} and len(out) == len(groups)
    assert all(x.most <= 7 for x in out)


@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_growing_median_matches_plain_code(spark, chunk):
    r = random.Random(chunk)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([1, None]), r.choice([*range(2000, 2008), None]), r.choice([None, *[r.randrange(40) / 4 for _ in range(9)]])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, g int, y int, v double")
    asked = spark.createDataFrame([("a", 1, y) for y in range(1999, 2012)] + [(None, None, 2005), ("c", 1, 2005)], "k string, g int, y int")
    for part, wanted in ((None, {x[:3] for x in rows if x[2] is not None and x[3] is not None}), (asked, {tuple(x) for x in asked.collect()})):
        want = {}
        for k, g, y in wanted:
            own = [x[3] for x in rows if x[:2] == (k, g) and None not in x[2:] and x[2] < y]
            if own:
                want[k, g, y] = (float(np.median(own)), len(own))
        got = R.growing_median(df, ["k", "g"], "y", "v", part, chunk=chunk)
        assert got.columns == ["k", "g", "y", "median", "n"]
        assert {(x.k, x.g, x.y): (x["median"], x.n) for x in got.collect()} == want


def _history_case(spark, n=3000, horses=4, seed=7):
    r = random.Random(seed)
    day = lambda n: dt.datetime(2001, 1, 1) + dt.timedelta(days=n)
    rows = [(i, r.choice([None, *range(horses)]), day(d := r.randrange(300)), day(d + r.randrange(60)), r.randrange(1, 9), r.random() * 100) for i in range(n)]
    return spark.createDataFrame(rows, "i int, horse int, date timestamp_ntz, seen timestamp_ntz, place int, v double")


@pytest.mark.parametrize("days", [None, 60])
def test_history_moves_once_by_entity(spark, days, monkeypatch):
    from parimart.operators import histories

    df = _history_case(spark)
    sums = {"n": F.lit(1), "v": F.col("v"), "dec": F.col("v").cast("decimal(12,3)")}
    ask = lambda: {x.i: x for x in R.prior_history(df, df, "horse", "date", "seen", "date", sums, days=days).collect()}
    plan = R.prior_history(df, df, "horse", "date", "seen", "date", sums, days=days)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Window" not in plan and "Join" not in plan
    got = ask()
    assert len(got) == 3000
    monkeypatch.setattr(histories, "HELD", 100)  # all are long
    blocks = ask()
    monkeypatch.setattr(histories, "HELD", 650)  # some are
    mixed = ask()
    for k, x in got.items():
        assert x.n == blocks[k].n == mixed[k].n and x.dec == blocks[k].dec == mixed[k].dec and x.v == pytest.approx(blocks[k].v) == pytest.approx(mixed[k].v)
    assert max(x.n for x in got.values()) > 50


def test_recent_form_moves_once_by_entity(spark, monkeypatch):
    from parimart.operators import histories

    df = _history_case(spark, 1200, 3, 11)
    form = lambda: H.recent_form(df, df, "horse", "date", "seen", "date", "place", "v", ["i"], ["i"], F.col("horse") != 2)
    plan = form()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Window" not in plan and "Join" not in plan
    got = {x.i: x for x in form().collect()}
    rows = df.collect()
    for x in got.values():
        runs = [r for r in rows if r.horse == x.horse != 2 and x.horse is not None and r.date < x.date and r.seen <= x.date]
        runs = sorted(runs, key=lambda r: (r.date, r.i), reverse=True)[:10]
        assert (x.starts_last_10, x.wins_last_10) == (len(runs), sum(r.place == 1 for r in runs))
        assert x.last_i == (runs[0].i if runs else None) and x.days_since_last_race == ((x.date - runs[0].date).days if runs else None)
        assert x.avg_finish_pos_5 == (pytest.approx(sum(r.place for r in runs[:5]) / len(runs[:5])) if runs else None)
    monkeypatch.setattr(histories, "HELD", 100)
    for x in form().collect():
        assert (x.last_i, x.starts_last_10, x.wins_last_10, x.avg_finish_time_sec_5) == (got[x.i].last_i, got[x.i].starts_last_10, got[x.i].wins_last_10, pytest.approx(got[x.i].avg_finish_time_sec_5))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 40, 7001])
def test_quantile_equals_percentile(spark, n):
    from parimart.operators import evaluate

    r = random.Random(n)
    df = spark.createDataFrame([(r.choice([None, 0.5, r.random(), r.gauss(0, 9)]),) for _ in range(n)], "x double")
    for q in (0.0, 0.3, 0.75, 1.0):
        made = evaluate.quantile(df, "x", q, "cut")
        assert "percentile(" not in made._jdf.queryExecution().optimizedPlan().toString()
        assert made.first()["cut"] == df.agg(F.percentile("x", F.lit(q))).first()[0]
