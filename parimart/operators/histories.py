"""Questions to an entity's history, answered in the tasks: rows meet once by entity, facts before questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType

from ..session import stored

#: History rows of an entity that a task may hold; entities with more are left to joins and windows.
HELD = 1 << 16

Answer = Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], list[pa.Array]]


def long_entities(history: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys of entities with more than ``HELD`` rows of ``history``, None if there is none.

    Rows are counted by a short hash of the keys first, so that counts move for the hashes, not for every entity; only rows
    whose hash is that frequent are counted by entity. Few entities can be long, so their list is small.
    """
    rows = history.select(*keys).withColumn("_hash", F.pmod(F.xxhash64(*keys), F.lit(1 << 16)))
    often = stored(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HELD).select("_hash"), "often")
    if often.isEmpty():
        return None
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    counts = rows.join(F.broadcast(often), "_hash", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    many = stored(counts.where(F.col("_rows") > HELD).select(*keys), "long")
    return None if many.isEmpty() else many


def by_length(target: DataFrame, history: DataFrame, keys: Sequence[str], names: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Target and history of entities of at most ``HELD`` history rows, and those of the others (None if there is none).

    ``history`` has the entity's ``keys``, the target calls them ``names``.
    """
    many = long_entities(history, keys)
    if many is None:
        return target, history, None, None
    target, many = stored(target, "target"), F.broadcast(many)
    on = [F.col(c) == F.col(k) for c, k in zip(names, keys, strict=True)]
    split = lambda how: (target.join(many, on, how), history.join(many, list(keys), how))
    return *split("left_anti"), *split("left_semi")


def ask_by_entity(target: DataFrame, asked: dict[str, str], facts: DataFrame, keys: Sequence[str], last: dict[str, Column], answer: Answer, found: StructType) -> DataFrame:
    """The target's columns and those of ``found``, which ``answer`` gives for each of its rows from the facts of its entity.

    ``asked`` tells what a question is made of and the target's columns for it, the entity's ``keys`` among it; ``last`` are further columns, computed from
    these after the rows have met. ``answer`` gets facts and questions, and the number of the entity of each. Rows are dealt by
    entity, and sorted so that facts come first: a task holds the facts of one entity and a batch. Questions with a null are
    spread over the tasks and get nulls.
    """
    stack = target.select(F.lit(1).cast("byte").alias("_side"), *[F.col(c).alias(n) for n, c in asked.items()], *target.columns).unionByName(
        facts.withColumn("_side", F.lit(0).cast("byte")), allowMissingColumns=True
    )
    kinds = dict(stack.dtypes)
    # What a question is made of moves once.
    twice = {c: n for n, c in asked.items() if kinds[c] == kinds[n]}
    stack = stack.drop(*twice)
    columns = [twice.get(c, c) for c in target.columns]
    own = list(dict.fromkeys(columns))
    whole = F.lit(True)
    for n in asked:
        whole &= F.col(n).isNotNull()
    spread = [c for c in own if isinstance(stack.schema[c].dataType, AtomicType)] or ["_side"]
    dealt = F.when((F.col("_side") == 0) | whole, F.xxhash64(*keys)).otherwise(F.xxhash64(*spread))
    stack = stack.repartition(dealt).sortWithinPartitions(*keys, "_side").withColumns(last)
    needs = [*asked, *last]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            rows = rows.combine_chunks()
            of = np.cumsum(_first(rows, keys)) - 1
            fact = rows["_side"].to_numpy() == 0
            held = rows.filter(pa.array(fact & (of == of[-1])))
            ask = ~fact
            if held is not None and not ask.any():
                continue
            known = ask.copy()
            for n in needs:
                known &= rows[n].is_valid().to_numpy().astype(bool)
            got = answer(rows.filter(pa.array(fact)), of[fact], rows.filter(pa.array(known)).select(needs), of[known])
            out = rows.filter(pa.array(ask)).select(own)
            at = np.cumsum(known[ask]) - 1
            places = pa.array(at, mask=~known[ask])
            for f, values in zip(found.fields, got, strict=True):
                out = out.append_column(f.name, values.take(places))
            yield from out.combine_chunks().to_batches()

    kept = [stack.schema[c] for c in own]
    out = stack.mapInArrow(walk, StructType([*kept, *found.fields]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(columns, target.columns)], *found.names)


def _first(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Which rows have other keys than the row before them, or a null among them."""
    first = np.ones(len(rows), bool)
    if len(rows) > 1:
        first[1:] = False
        for k in keys:
            same = pc.fill_null(pc.equal(rows[k].slice(1), rows[k].slice(0, len(rows) - 1)), False)
            first[1:] |= ~same.to_numpy().astype(bool)
    return first


@dataclass(frozen=True)
class Question:
    """What ``ask_together`` finds for a row among the facts of its entity that have the same ``group``.

    ``answer`` gets facts with the columns ``facts`` (by the names of the rows' columns) and gives what ``found`` names, ``empty``
    where a row asks nothing. ``apart`` adds the same columns to rows of entities that are too long for a task, from their facts.
    """

    answer: Answer
    facts: dict[str, str]
    found: StructType
    apart: Callable[[DataFrame, DataFrame], DataFrame]
    group: Sequence[str] = ()
    empty: int | None = None
    where: str | None = None  # a boolean column: which rows are facts


def ask_together(
    rows: DataFrame, long: DataFrame | None, entity: str, when: tuple[str, str, str], days: int | None, values: dict[str, Column], questions: Sequence[Question], keep: Sequence[str]
) -> DataFrame:
    """The columns ``keep`` of ``rows`` and the answers to several ``questions``: each row is a fact of its entity and asks about the others.

    ``when`` has the columns of date, time of availability and time of the question; ``days`` before the date is the questions' ``_since``.
    ``values`` are computed once the rows have met. Rows move once, and are not doubled into facts and questions; a task holds
    the rows of one entity and a batch. ``long`` has the entities with more rows than that (``long_entities``). Rows without the
    entity are spread over the tasks.
    """
    date, available, as_of = when
    time = rows.select(F.coalesce(available, as_of).alias("t")).schema["t"].dataType
    made = {"_known_at": F.col(available).cast(time), "_asked_at": F.col(as_of).cast(time), **values}
    if days is not None:
        made["_from_date"] = (F.col(date) - F.expr(f"interval {days} days")).cast(rows.schema[date].dataType)
    short = rows if long is None else rows.join(F.broadcast(long), entity, "left_anti")
    spread = [c for c in rows.columns if c != entity and isinstance(rows.schema[c].dataType, AtomicType)] or [entity]
    dealt = F.when(F.col(entity).isNotNull(), F.xxhash64(entity)).otherwise(F.xxhash64(*spread))
    met = short.repartition(dealt).sortWithinPartitions(entity).withColumns(made)
    used = [c for q in questions for c in (*q.group, *q.facts.values(), *filter(None, [q.where]))]
    met = met.select(*dict.fromkeys([*keep, entity, date, *made, *used]))

    def answered(part: pa.Table) -> Iterator[pa.RecordBatch]:
        own = np.cumsum(_first(part, [entity])) - 1
        valid = lambda *columns: np.logical_and.reduce([part[c].is_valid().to_numpy().astype(bool) for c in columns])
        out = part.select(keep)
        for q in questions:
            there, of = valid(entity, date, *q.group), own
            for c in q.group:
                codes = part[c].combine_chunks().dictionary_encode()
                codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
                codes = codes.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.unique(of * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
            fact, ask = there & valid("_known_at"), there & valid("_asked_at")
            if q.where is not None:
                fact &= pc.fill_null(part[q.where], False).to_numpy().astype(bool)
            facts = pa.table({"_d": part[date], "_t": part["_known_at"], **{n: part[c] for n, c in q.facts.items()}}).filter(pa.array(fact))
            asks = pa.table({"_d": part[date], "_t": part["_asked_at"], **({} if days is None else {"_since": part["_from_date"]})}).filter(pa.array(ask))
            places = pa.array(np.cumsum(ask) - 1, mask=~ask)
            for f, got in zip(q.found.fields, q.answer(facts.combine_chunks(), of[fact], asks, of[ask]), strict=True):
                got = got.take(places)
                out = out.append_column(f.name, got if q.empty is None else pc.fill_null(got, q.empty))
        yield from out.combine_chunks().to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is None:
                done, held = held, None
            elif not batch.num_rows:
                continue
            else:
                part = pa.Table.from_batches([batch])
                part = (part if held is None else pa.concat_tables([held, part])).combine_chunks()
                last = int(np.flatnonzero(_first(part, [entity]))[-1])
                done, held = part.slice(0, last), part.slice(last)
            if done is not None and len(done):
                yield from answered(done)

    names = [f for q in questions for f in q.found.fields]
    out = met.mapInArrow(walk, StructType([*[met.schema[c] for c in keep], *names]))
    if long is not None:
        apart = rows.join(F.broadcast(long), entity, "left_semi").withColumns(made)
        facts = apart
        for q in questions:
            apart = q.apart(apart, facts if q.where is None else facts.where(q.where))
        out = out.unionByName(apart.select(*[F.col(f.name).cast(f.dataType) for f in out.schema.fields]))
    return out


def plain(column: pa.ChunkedArray) -> np.ndarray:
    """Values without nulls as an array that sorts: dates and times as numbers."""
    kind = column.type
    if pa.types.is_date32(kind):
        column = column.cast(pa.int32())
    elif pa.types.is_timestamp(kind):
        column = column.cast(pa.int64())
    return column.to_numpy()


def ranges(facts: pa.Table, of: np.ndarray, asks: pa.Table, by: np.ndarray, since: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the facts by entity and date, and from where to where in it each question's facts before its date are."""
    d, day = plain(facts["_d"]), plain(asks["_d"])
    order = np.lexsort((d, of))
    days = np.unique(d)
    wide = len(days) + 1
    keys = (of * wide + np.searchsorted(days, d))[order]
    low = 0 if since is None else np.searchsorted(days, plain(asks[since]))
    return order, np.searchsorted(keys, by * wide + low), np.searchsorted(keys, by * wide + np.searchsorted(days, day))


def known_sums(names: Sequence[str], since: str | None) -> Answer:
    """Sums of the facts before a question's date (not before ``since``) that were known by its time.

    A range is cut into at most two blocks of every power of two. In each block facts are in order of time, with running sums:
    no sums are subtracted, and no pairs are made.
    """

    def answer(facts: pa.Table, of: np.ndarray, asks: pa.Table, by: np.ndarray) -> list[pa.Array]:
        order, lo, hi = ranges(facts, of, asks, by, since)
        n = len(order)
        t = plain(facts["_t"])[order]
        values = [facts[c].to_numpy()[order] for c in names]
        rank = np.empty(n, np.int64)
        rank[np.argsort(t, kind="stable")] = np.arange(n)
        upto = np.searchsorted(np.sort(t), plain(asks["_t"]), "right")
        sums = [np.zeros(len(by), v.dtype) for v in values]
        place = np.arange(n)
        for k in range(int((hi - lo).max(initial=0)).bit_length()):
            a, b = (lo + (1 << k) - 1) >> k, hi >> k
            left, right = np.flatnonzero((a < b) & (a % 2 == 1)), np.flatnonzero((a < b) & (b % 2 == 1))
            if not len(left) + len(right):
                continue
            keys = (place >> k) * n + rank
            sort = np.argsort(keys)
            keys, blocks = keys[sort], ((n - 1) >> k) + 1
            parts = [(left, a[left]), (right, b[right] - 1)]
            parts = [(who, block, np.searchsorted(keys, block * n + upto[who]) - (block << k)) for who, block in parts]
            for v, s in zip(values, sums):
                run = np.zeros(blocks << k, v.dtype)
                run[:n] = v[sort]
                run = run.reshape(blocks, 1 << k).cumsum(axis=1)
                for who, block, many in parts:
                    some = many > 0
                    s[who[some]] += run[block[some], many[some] - 1]
        return [pa.array(s, facts[c].type) for s, c in zip(sums, names)]

    return answer


def last_known(fields: Sequence[str], ties: Sequence[str], most: int) -> Answer:
    """The newest ``most`` facts before a question's date that were known by its time, as a list of ``fields``, newest first.

    Facts of one date are ordered by ``ties``. Walks go back through an entity's facts, and over blocks of which nothing was known.
    """

    def answer(facts: pa.Table, of: np.ndarray, asks: pa.Table, by: np.ndarray) -> list[pa.Array]:
        sort = [("_of", "ascending"), ("_d", "ascending"), *[(c, "ascending") for c in ties]]
        order = pc.sort_indices(facts.append_column("_of", pa.array(of)), sort_keys=sort, null_placement="at_start")
        facts = facts.take(order).combine_chunks()
        lo, p = ranges(facts, of[order.to_numpy()], asks, by, None)[1:]
        p = p.copy()
        t, at = plain(facts["_t"]), plain(asks["_t"])
        least = [t]
        while len(least[-1]) > 1:
            whole = len(least[-1]) // 2 * 2
            least.append(np.minimum(least[-1][0:whole:2], least[-1][1:whole:2]))
        got, many = np.zeros((len(by), most), np.int64), np.zeros(len(by), np.int64)
        who = np.flatnonzero(p > lo)
        while len(who):
            q = p[who]
            hit = t[q - 1] <= at[who]
            got[who[hit], many[who[hit]]] = q[hit] - 1
            many[who[hit]] += 1
            step, skip = np.ones(len(who), np.int64), np.flatnonzero(~hit)
            for k in range(1, len(least)):
                skip = skip[q[skip] % (1 << k) == 0]
                skip = skip[least[k][(q[skip] >> k) - 1] > at[who[skip]]]
                if not len(skip):
                    break
                step[skip] = 1 << k
            p[who] = q - step
            who = who[(p[who] > lo[who]) & (many[who] < most)]
        taken = pa.array(got[np.arange(most) < many[:, None]])
        parts = [facts[c].combine_chunks().take(taken) for c in fields]
        parts = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in parts]
        ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
        return [pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, names=list(fields)))]

    return answer
