import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parimart.operators import evaluate as K
from parimart.operators import features as H
from parimart.operators import ordering as O

SF = "/root/testdata/sf0.001"


def unfolds_last(df):
    """The grid is unfolded (Generate) above every aggregate but the last sums over races, of which there are two steps."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return "Generate" in plan and plan.index("Generate") < plan.index("collect_list")


@pytest.mark.parametrize("name", ["J6_gamma_global_whole", "H3_beta_losses_whole", "K20_blend_grid_whole"])
def test_grids_are_unfolded_after_races_are_gathered(spark, name):
    assert unfolds_last(entry.queries()[name](spark, SF))


def _races(n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        p = rng.random(2 + i % 5)
        order = rng.permutation(len(p)) + 1
        rows += [(i, k, float(x), int(o), i // 7) for k, (x, o) in enumerate(zip(p / p.sum(), order, strict=True))]
    return rows


def test_compact_likelihoods_give_the_same_windows(spark):
    rows = _races()
    probs = spark.createDataFrame(rows, "race int, item int, p double, position int, day int")
    grid = (0.5, 0.8, 1.1)
    curves = O.gamma_likelihood(probs, probs, "race", "item", "p", grid)
    compact = O.gamma_likelihood(probs, probs, "race", "item", "p", grid, compact=True)
    assert compact.count() == 60 and curves.count() == 180
    got = {r.race: r.gamma for r in O.fit_gamma_walkforward(compact, ["race"], "race", window=7, grid=grid).collect()}
    ll = {(r.race, r.gamma): r.ll for r in curves.collect()}
    for i in range(60):
        want = max(grid, key=lambda g: sum(ll[k, g] for k in range(i - 7, i))) if i >= 7 else 1.0
        assert got[i] == want
    placed = {}
    for race, _, p, at, _ in rows:
        placed.setdefault(race, {})[at] = p
    for (race, g), value in ll.items():
        s, want = sum(p**g for p in placed[race].values()), 0.0
        for k in (1, 2, 3):
            if k in placed[race]:
                want += g * np.log(placed[race][k]) - np.log(max(s, 1e-300))
                s -= placed[race][k] ** g
        if len(placed[race]) > 3:  # else the last factor is the logarithm of a rounding error
            assert value == pytest.approx(want)


def test_races_with_a_finisher_without_probability_are_left_out(spark):
    probs = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.4), (2, 1, 1.0)], "race int, item int, p double")
    finish = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 9, 2)], "race int, item int, position int")
    assert [r.race for r in O.gamma_likelihood(probs, finish, "race", "item", "p", [1.0]).collect()] == [1]


def test_windows_longer_than_a_block_and_shorter_histories(spark, monkeypatch):
    from parimart.operators import grids

    monkeypatch.setattr(grids, "BLOCK", 10)
    rng = np.random.default_rng(5)
    values = rng.random((83, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "race int, c array<double>")
    f = lambda b: b.column("c").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
    for window in (4, 10, 30, 200):
        for current in (False, True):
            out = grids.best_before(rows, ["race"], "race", window, f, [1.0, 2.0, 3.0], lambda t, n: t.argmax(axis=1), "g", current).collect()
            assert len(out) == 83
            for r in out:
                end = r.race + current
                part = values[max(0, end - window) : end]
                assert r.n == r.race + 1 and (not len(part) or r.g == 1.0 + part.sum(axis=0).argmax())


def test_blends_and_betas_equal_plain_sums(spark):
    rows = _races()
    df = spark.createDataFrame(rows, "race int, item int, p double, position int, day int").withColumn("lg", F.ln("p")).withColumn("one", F.col("p") * 2)
    got = {(r.day, r.w0, r.w1): (r.nll, r.races) for r in K.blend_losses(df, "race", ["lg", "one"], F.col("position") == 1, [[0.0, 1.0], [0.5, 0.2]], group=["day"]).collect()}
    beta = {(r.race, r.beta): r.loss for r in H.beta_losses(df, "race", "p", F.col("position") == 1, [0.5, 2.0]).collect()}
    for day in range(9):
        for g in ([0.0, 1.0], [0.5, 0.2]):
            total = 0.0
            for race in {r[0] for r in rows if r[4] == day}:
                mine = [(g[0] * np.log(r[2]) + g[1] * 2 * r[2], r[3]) for r in rows if r[0] == race]
                total += np.log(sum(np.exp(z) for z, _ in mine)) - next(z for z, at in mine if at == 1)
            assert got[day, *g][0] == pytest.approx(total)
    for (race, b), loss in beta.items():
        mine = [(r[2] ** b, r[3]) for r in rows if r[0] == race]
        assert loss == pytest.approx(-np.log(next(x for x, at in mine if at == 1) / sum(x for x, _ in mine)))
