"""Ordering probabilities over combinations: Harville, Henery and Stern models, unfolded within a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import stored
from .grids import best_before, lists, over_grid
from .lines import Lines, ascending, line_keys, over_lines

# What each pool returns of its stakes, and the usual exponent for later places.
RETURN = {"quinella": 0.775, "wide": 0.775, "exacta": 0.75, "trio": 0.75, "trifecta": 0.725, "bracket_quinella": 0.775}
GAMMA = 0.856
# Exponents that are fitted.
GAMMAS = tuple(round(0.50 + 0.005 * k, 3) for k in range(101))


def _gammas(gamma: float | Column | Sequence[float], places: int, raw_first: bool) -> list[float | Column]:
    gammas = [gamma] * places if isinstance(gamma, (int, float, Column)) else list(gamma)
    return [1.0, *gammas[1:]] if raw_first else gammas


def strengths(df: DataFrame, group: str, item: str, p: str, models: Sequence[Sequence[float | Column]], keep: Sequence[str] = ()) -> tuple[DataFrame, list[list[str]]]:
    """p ** gamma for each model and place, once for equal exponents, and the names of these columns."""
    names, columns = {}, []
    for g in [g for m in models for g in m]:
        key = id(g) if isinstance(g, Column) else float(g)
        if key not in names:
            names[key] = f"s{len(names)}"
            columns.append(F.pow(p, g if isinstance(g, Column) else F.lit(float(g))).alias(names[key]))
    of = [[names[id(g) if isinstance(g, Column) else float(g)] for g in m] for m in models]
    return df.where(F.col(p) > 0).select(F.col(group).alias("_g"), F.col(item).alias("_i"), *keep, *columns), of


def _unfolded(df: DataFrame, group: str, item: str, p: str, places: int, gammas: Sequence[float | Column], together: bool) -> DataFrame:
    rows, models = strengths(df, group, item, p, [gammas])
    names = "abcdefgh"[:places]
    kinds = rows.schema
    schema = StructType([StructField(group, kinds["_g"].dataType), *[StructField(n, kinds["_i"].dataType) for n in names], StructField("prob", DoubleType())])

    def listed(heads: pa.Table, items: np.ndarray, lines: Callable[[int], Lines]) -> pa.Table:
        found = ascending(lines(places)) if together else lines(places)
        values = pa.array(items, heads["_i"].type)
        columns = [heads["_g"].take(pa.array(found.of)), *[values.take(pa.array(c)) for c in found.codes], pa.array(found.probs[0], mask=~found.there[0])]
        return pa.table(dict(zip([group, *names, "prob"], columns)))

    return over_lines(rows, "_g", "_i", models, listed, schema, places)


def sequences(df: DataFrame, group: str, item: str, p: str, places: int, gamma: float | Column | Sequence[float] = 1.0, raw_first: bool = False) -> DataFrame:
    """All ordered prefixes ``(group, a, b, c ..., prob)`` of ``places`` items.

    One ``gamma`` for every place (1 is Harville), a column with each group's, or one a place; ``raw_first`` leaves the first place's exponent at
    1. Each factor is closed-form: the strength over the group's total less those already placed. Runners of a group meet once, and tasks
    unfold the lines (``over_lines``).
    """
    return _unfolded(df, group, item, p, places, _gammas(gamma, places, raw_first), False)


def _sorted_pair(df: DataFrame, x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def combos(df: DataFrame, group: str, item: str, p: str, pool: str, gamma: float | Column = GAMMA, raw_first: bool = True) -> DataFrame:
    """All selections of a pool with their probability: ``(group, a[, b[, c]], prob)``; unordered ones ascend."""
    if pool == "win":
        return df.where(F.col(p) > 0).select(group, F.col(item).alias("a"), F.col(p).alias("prob"))
    if pool in ("exacta", "quinella"):
        return _unfolded(df, group, item, p, 2, _gammas(gamma, 2, raw_first), pool == "quinella")
    if pool == "trio":
        return _unfolded(df, group, item, p, 3, _gammas(gamma, 3, raw_first), True)
    triples = sequences(df, group, item, p, 3, gamma, raw_first)
    if pool == "trifecta":
        return triples
    if pool == "wide":  # a pair pays if both are among the first three
        pairs = F.explode(F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))
        out = triples.select(group, pairs.alias("x"), "prob").select(group, "x.a", "x.b", "prob")
        return out.groupBy(group, *_sorted_pair(out, "a", "b")).agg(F.sum("prob").alias("prob"))
    if pool == "place":
        out = triples.select(group, F.explode(F.array("a", "b", "c")).alias("a"), "prob")
        return out.groupBy(group, "a").agg(F.sum("prob").alias("prob"))
    raise ValueError(f"unknown pool {pool}")


def pool_likelihood(probs: DataFrame, winners: DataFrame, group: str, item: str, p: str, pools: dict[str, Sequence[str]], gamma: float | Column) -> DataFrame:
    """Sums for chunks of groups, ``(pool, races, combos, harville_ll, henery_ll)``: see ``compose.exotic_likelihood``.

    A group's winning selections come to its runners as one list; lines are unfolded and compared with it in the tasks.
    """
    used = list(dict.fromkeys(c for columns in pools.values() for c in columns))
    kind = probs.schema[item].dataType
    won = winners.groupBy(F.col(group).alias("_wg")).agg(*[F.collect_list(F.struct(*[F.col(c).cast(kind).alias(c) for c in used])).alias("_won")])
    rows, models = strengths(probs, group, item, p, [[1.0] * 3, [1.0, gamma, gamma]])
    rows = rows.join(won, F.col("_g") == F.col("_wg")).drop("_wg")
    numbers = ["races", "combos"], ["harville_ll", "henery_ll"]
    schema = StructType([StructField("at", LongType()), *[StructField(n, LongType()) for n in numbers[0]], *[StructField(n, DoubleType()) for n in numbers[1]]])

    def judged(heads: pa.Table, items: np.ndarray, lines: Callable[[int], Lines]) -> pa.Table:
        many = heads["_won"].combine_chunks()
        flat = many.flatten()
        begin = np.repeat(np.arange(len(many)), np.diff(many.offsets.to_numpy()))
        out = []
        for k, (pool, columns) in enumerate(pools.items()):
            found = lines(len(columns))
            found = ascending(found) if pool in ("trio", "quinella") else found.merged(np.maximum, -np.inf)
            whole = np.ones(len(flat), bool)
            for c in columns:
                whole &= flat.field(c).is_valid().to_numpy(zero_copy_only=False)
            picked = [flat.field(c).filter(pa.array(whole)).to_numpy(zero_copy_only=False) for c in columns]
            of = begin[whole]
            codes = [np.minimum(np.searchsorted(items, x), len(items) - 1) for x in picked]
            known = np.ones(len(of), bool)
            for x, c in zip(picked, codes):
                known &= items[c] == x
            h, g = (np.where(t, x, -1.0) for x, t in zip(found.probs, found.there))
            own = np.isin(found.of, of) & (g > 0)
            hit = own & np.isin(found.keys(), line_keys(of[known], [c[known] for c in codes], len(items)))
            row = {"at": k, "races": len(np.unique(found.of[own])), "combos": int(own.sum())}
            for n, x in zip(numbers[1], (h, g)):
                some = hit & (x > 0)
                row[n] = float(np.log(np.maximum(x[some], 1e-12)).sum()) if some.any() else None
            out.append(row)
        kinds = [("at", pa.int64()), *[(n, pa.int64()) for n in numbers[0]], *[(n, pa.float64()) for n in numbers[1]]]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    parts = over_lines(rows, "_g", "_i", models, judged, schema, max(map(len, pools.values())))
    names = F.array(*[F.lit(n) for n in pools])
    sums = parts.groupBy("at").agg(*[F.sum(n).alias(n) for n in (*numbers[0], *numbers[1])])
    every = probs.sparkSession.createDataFrame([(k,) for k in range(len(pools))], "at long")
    zeros = [F.coalesce(n, F.lit(0)).alias(n) for n in numbers[0]]
    return every.join(F.broadcast(sums), "at", "left").select(names[F.col("at").cast("int")].alias("pool"), *zeros, *numbers[1])


def bracket_pairs(quinella: DataFrame, gates: DataFrame, group: str) -> DataFrame:
    """Quinella probabilities summed by pair of brackets; runners without a bracket are dropped."""
    # Pairs move once, by group; a group's gates come as one list.
    listed = gates.groupBy(group).agg(F.collect_list(F.struct("item", "bracket")).alias("_w"))
    out = quinella.join(listed, group)
    for n in "ab":
        out = out.select("*", F.explode(F.filter("_w", lambda x: x["item"] == F.col(n))["bracket"]).alias(f"w{n}"))  # noqa: B023
    return out.groupBy(group, F.least("wa", "wb").alias("lo"), F.greatest("wa", "wb").alias("hi")).agg(F.sum("prob").alias("prob"), F.count(F.lit(1)).alias("points"))


def aggregate_brackets(probs: DataFrame, gates: DataFrame, group: str, item: str, p: str) -> DataFrame:
    return probs.join(gates, [group, item]).groupBy(group, "bracket").agg(F.sum(p).alias("prob"))


def price(df: DataFrame, pool: str) -> DataFrame:
    """Fair odds and the estimated payout per unit."""
    return df.where("prob > 0").withColumn("fair_odds", 1.0 / F.col("prob")).withColumn("est_payout", RETURN[pool] / F.col("prob"))


def value_tag(combos_: DataFrame, probs: DataFrame, group: str, item: str, p: str, places: Sequence[str]) -> DataFrame:
    """chalk if all runners are in the first third of the market (two at least), value if none is, else blend."""
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(F.desc(p), item))
    cut = F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)).over(w) / 3))
    fav = probs.where(F.col(p) > 0).select(group, F.col(item).alias("_i"), (rank <= cut).cast("int").alias("_f"))
    out, total = combos_, F.lit(0)
    for n in places:
        out = out.join(fav.withColumnsRenamed({"_i": n, "_f": f"_f{n}"}), [group, n], "left")
        total += F.coalesce(f"_f{n}", F.lit(0))
    tag = F.when(total == len(places), "chalk").when(total == 0, "value").otherwise("blend")
    return out.withColumn("tag", tag).drop(*[f"_f{n}" for n in places])


def formation(sets: DataFrame, ticket: str, places: int, ordered: bool) -> DataFrame:
    """Lines of tickets from the items allowed at each place, ``sets(ticket, place, item)``: no item twice in a line.

    A box has the same items at every place; an axis is a place with one item. Unordered lines are listed once. Items meet
    once, by ticket, as a list for each place; ordered lines are unfolded from these one by one, unordered ones are told apart in
    the ticket's row.
    """
    names = "abcdefgh"[:places]
    sides = [F.collect_list(F.when(F.col("place") == k, F.struct(F.col("item").alias("item")))).alias(f"_{n}") for k, n in enumerate(names)]
    out = sets.where(F.col(ticket).isNotNull() & F.col("item").isNotNull()).groupBy(ticket).agg(*sides)
    out = out.select(ticket, *[F.col(f"_{n}")["item"].alias(f"_{n}") for n in names])
    if ordered:
        for k, n in enumerate(names):
            out = out.select("*", F.explode(f"_{n}").alias(n))
            for earlier in names[:k]:
                out = out.where(F.col(n) != F.col(earlier))
        return out.select(ticket, *names)
    lines = F.transform("_a", lambda x: F.array(x))
    for n in names[1:]:
        more = lambda line: F.transform(F.filter(f"_{n}", lambda y: ~F.array_contains(line, y)), lambda y: F.concat(line, F.array(y)))  # noqa: B023, E731
        lines = F.flatten(F.transform(lines, more))
    lines = F.array_distinct(F.transform(lines, lambda line: F.array_sort(line)))
    out = out.select(ticket, F.explode(lines).alias("_l"))
    return out.select(ticket, *[F.col("_l")[k].alias(n) for k, n in enumerate(names)])


def finalize_tickets(lines: DataFrame, ticket: str, unit: float, most: float = 0.98) -> DataFrame:
    """Cost, hit probability, expected and average payout, best case and variance label from priced lines."""
    hit = F.least(F.lit(most), F.sum("prob"))
    out = lines.groupBy(ticket).agg(
        F.count(F.lit(1)).alias("n_lines"), (F.count(F.lit(1)) * F.lit(unit)).alias("cost"), hit.alias("hit_prob"),
        F.sum(F.col("prob") * F.col("est_payout") * unit).alias("expected"), F.avg(F.col("est_payout") * unit).alias("avg_payout"),
        F.max(F.col("est_payout") * unit).alias("best_case"),
    )
    # Rounded, so that a sum that is the limit itself does not depend on the order it was taken in.
    high = (F.round("hit_prob", 12) < 0.15) | (F.round(F.col("avg_payout") / max(1.0, unit), 9) > 30)
    return out.withColumn("variance", F.when(high, "high").otherwise("low"))


def classify_structure(lines: DataFrame, ticket: str, places: int, ordered: bool) -> DataFrame:
    """Whether a ticket's distinct lines are a full box over its items."""
    names = list("abcdefgh"[:places])
    line = F.concat_ws("-", *names)
    items = F.array_distinct(F.array_compact(F.flatten(F.collect_set(F.array(*names)))))
    by = lines.where(F.col(ticket).isNotNull()).groupBy(ticket).agg(
        F.count(F.lit(1)).alias("rows"), F.size(F.collect_set(line)).cast("long").alias("n_lines"), F.size(items).cast("long").alias("n")
    )
    size = F.lit(1)
    for k in range(places):
        size *= F.col("n") - k
    full = size if ordered else size / F.factorial(F.lit(places))
    box = (F.col("n_lines") == full) & (F.col("rows") == F.col("n_lines"))
    return by.select(ticket, "n", "n_lines", F.when(box, "box").otherwise("custom").alias("structure"))


def placed_fields(probs: DataFrame, finish: DataFrame, group: str, item: str, p: str, places: int) -> DataFrame:
    """A row a group: ``lps``, the logs of its items' probabilities, and ``firsts``, those of its first ``places`` finishers (null if none).

    Groups with a finisher that has no probability are left out, and those without a first one.
    """
    lp = F.ln(F.greatest(F.col(p), F.lit(1e-12)))
    placed = finish.where(F.col("position") <= places).select(group, F.col(item).alias("_i"), F.lit(None).cast("double").alias("_lp"), F.col("position").cast("int").alias("_at"))
    rows = probs.select(group, F.col(item).alias("_i"), lp.alias("_lp"), F.lit(None).cast("int").alias("_at")).unionByName(placed)
    items = rows.repartition(group).groupBy(group, "_i").agg(F.collect_list("_lp").alias("_lp"), F.collect_list("_at").alias("_at"))
    at = [F.max(F.when(F.array_contains("_at", k), F.array_max("_lp"))) for k in range(1, places + 1)]
    each = F.flatten(F.array_repeat("_lp", F.greatest(F.lit(1), F.size("_at"))))
    lost = F.bool_or((F.size("_lp") == 0) | F.col("_i").isNull() & (F.size("_at") > 0))
    fields = items.groupBy(group).agg(F.array_sort(F.flatten(F.collect_list(each))).alias("lps"), F.array(*at).alias("firsts"), lost.alias("_lost"))
    return fields.where(F.col(group).isNotNull() & ~F.col("_lost") & F.col("firsts")[0].isNotNull()).drop("_lost")


def _likelihoods(grid: Sequence[float], places: int, digits: int | None = None) -> Callable[[pa.RecordBatch], np.ndarray]:
    def f(batch: pa.RecordBatch) -> np.ndarray:
        lps, begin = lists(batch.column("lps"))
        firsts = lists(batch.column("firsts"))[0].astype(float).reshape(-1, places)
        out = np.empty((batch.num_rows, len(grid)))
        for j, g in enumerate(grid):
            left = np.add.reduceat(np.exp(g * lps), begin)
            ll = np.zeros(len(left))
            for k in range(places):
                term = g * firsts[:, k]
                there = ~np.isnan(term)
                ll += np.where(there, term - np.log(np.maximum(left, 1e-300)), 0.0)
                left = left - np.where(there, np.exp(term), 0.0)
            out[:, j] = ll
        return out if digits is None else np.round(out, digits)

    return f


def gamma_likelihood(probs: DataFrame, finish: DataFrame, group: str, item: str, p: str, grid: Sequence[float], places: int = 3, compact: bool = False) -> DataFrame:
    """``(group, gamma, ll)``: log-likelihood of each group's first ``places`` finishers over a grid of exponents.

    A group is one row with its probabilities until the grid is unfolded, after all shuffles; with ``compact`` that row is returned, for
    ``fit_gamma_walkforward`` with a ``grid``. Groups with a finisher that has no probability are left out.
    """
    fields = placed_fields(probs, finish, group, item, p, places)
    return fields if compact else over_grid(fields, [group], _likelihoods(grid, places), grid, "gamma", "ll")


def fit_gamma_walkforward(
    curves: DataFrame, order: Sequence[str], group: str, window: int = 1000, default: float = 1.0, grid: Sequence[float] | None = None, places: int = 3, digits: int | None = None
) -> DataFrame:
    """``(group, gamma)``: for each group the exponent that fits the ``window`` groups before it best.

    Ties go to the smallest exponent; earlier groups get ``default``. ``curves`` has a row for each group and exponent, or with
    ``grid`` the compact rows of ``gamma_likelihood``, whose likelihoods are rounded to ``digits``. Groups are numbered in ``order``,
    and ``best_before`` sums their curves in blocks.
    """
    cols = list(dict.fromkeys([*order, group]))
    if grid is None:
        wide = stored(curves.groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct("gamma", "ll"))).alias("_c")), "curves")
        first = wide.select(F.col("_c.gamma").alias("g")).first()
        grid = first["g"] if first else [default]
        rows, n = wide.select(*cols, F.col("_c.ll").alias("_c")), len(grid)
        f = lambda batch: lists(batch.column("_c"))[0].astype(float).reshape(-1, n)
    else:
        grid = sorted(grid)
        rows, f = curves, _likelihoods(grid, places, digits)
    best = best_before(rows, cols, group, window, f, grid, lambda total, count: total.argmax(axis=1), "gamma")
    return best.select(group, F.when(F.col("n") > window, F.col("gamma")).otherwise(default).alias("gamma"))


def fit_gamma_global(curves: DataFrame) -> DataFrame:
    """The exponent with the largest likelihood over all groups, ties to the smallest; one row."""
    total = curves.groupBy("gamma").agg(F.sum("ll").alias("ll"))
    return total.agg(F.max_by("gamma", F.struct("ll", -F.col("gamma"))).alias("gamma"), F.max("ll").alias("ll"))
