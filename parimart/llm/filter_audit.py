"""What each filter of a chain does before, after and beside the others, for every order, from one pass over the documents.

A document becomes a 32-bit word: bit S says whether it survives the set S of filters. Positional popcounts of these words,
by carry-save adders, give the survivors of every set, per part and label; every figure of every order follows from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, blocks, utf8

FILTERS = "ABCDE"
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_BEGIN = (np.arange(256) & 0xC0) != 0x80


def survival_words(failed: np.ndarray) -> np.ndarray:
    """The word of each set of failed filters: bit S is set if none of them is in S."""
    table = np.array([sum(1 << s for s in range(32) if not s & f) for f in range(32)], np.uint32)
    return table[failed]


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many words have each of 32 bits, by carry-save adders over lanes of the array."""
    lanes = max(1, min(4096, len(words) // 16))
    planes = [np.zeros(lanes, np.uint32) for _ in range(4)]
    total = np.zeros(32, np.int64)

    def tally(v: np.ndarray, weight: int) -> None:
        for b in range(32):
            total[b] += weight * int(np.count_nonzero(v & np.uint32(1 << b)))

    def add(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        """The carries of ``planes[level] + a + b``, whose sum stays in the plane."""
        c = planes[level]
        u = a ^ b
        planes[level] = u ^ c
        return (a & b) | (u & c)

    step = 16 * lanes
    whole = len(words) // step * step
    for x in words[:whole].reshape(-1, 16, lanes):
        twos = [add(x[i], x[i + 1], 0) for i in range(0, 16, 2)]
        fours = [add(twos[i], twos[i + 1], 1) for i in range(0, 8, 2)]
        eights = [add(fours[i], fours[i + 1], 2) for i in range(0, 4, 2)]
        tally(add(eights[0], eights[1], 3), 16)
    for level, v in enumerate(planes):
        tally(v, 1 << level)
    tally(words[whole:], 1)
    return total


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of a block of texts: few words, few distinct ones, many capitals, symbols."""
    w = Words(data, offsets)
    n = len(w.count)
    order = np.lexsort((w.hash, w.text))
    text, hashed = w.text[order], w.hash[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    distinct = np.bincount(text[new], minlength=n)

    def per_text(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(kind[w.data]), w.offsets))

    rules = (w.count < 100, 100 * distinct < 80 * w.count, 100 * per_text(_UPPER) > 10 * per_text(_BEGIN), per_text(_SYMBOL) > 0)
    return sum(rule.astype(np.int32) << i for i, rule in enumerate(rules))


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, failed)``: a bit for each of ``FILTERS``, judged on whole texts; null text and part are empty.

    E marks a document whose text a smaller id has too. Texts are told apart by SHA-256; rows of one text meet by
    (digest, id), so that a text that many documents share is dealt to many tasks. A row without an id is no copy.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            parts = [failures(data, offsets[lo : hi + 1]) for lo, hi in blocks(offsets)]
            failed = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(failed.astype(np.int32))], ["id", "part", "digest", "failed"])

    kind = docs.schema[id_col].dataType.simpleString()
    judged = rows.mapInArrow(judge, f"id {kind}, part string, digest binary, failed int")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return judged.join(firsts, ["digest", "id"], "left").select("id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"))


def subset_survivors(judged: DataFrame) -> DataFrame:
    """``(part, label, subset, n)``: documents that survive each set of filters, from ``(part, failed, good, toxic)``.

    ``label`` is 0 for all, 1 for good, 2 for toxic ones. A task sends 96 counts a part and batch, which Spark adds up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            part, words = names.indices.to_numpy(zero_copy_only=False), survival_words(batch.column(1).to_numpy())
            kinds = [np.ones(len(words), bool), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))]
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(len(names.dictionary) + 1))
            for p in range(len(names.dictionary)):
                own = order[at[p] : at[p + 1]]
                n = np.concatenate([positional_counts(words[own[kind[own]]]) for kind in kinds])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names.dictionary[p].as_py()] * 96, pa.string()), pa.array(np.repeat(np.arange(3, dtype=np.int32), 32)),
                     pa.array(np.tile(np.arange(32, dtype=np.int32), 3)), pa.array(n)],
                    ["part", "label", "subset", "n"],
                )

    counts = judged.select("part", "failed", "good", "toxic").mapInArrow(count, "part string, label int, subset int, n long")
    return counts.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    good_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """One row per part, order of the five filters and step, with what the step's filter does there.

    ``kept``, ``removed``, ``redundant`` (fails, but is gone already), ``unique_fails`` (fails this filter alone), ``good_lost``,
    ``toxic_lost`` and ``shapley`` (removed, summed over all orders) are counts within the part. Repeated rows count each;
    of several labels of an id the larger one counts, ids without labels and rows without ids are neither good nor toxic.
    An empty table gives no rows.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col(good_col) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("toxic")
    )
    judged = failed_filters(docs, id_col, text_col, part_col).join(marks, "id", "left")
    judged = judged.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    of = lambda label: F.map_from_entries(F.collect_list(F.when(F.col("label") == label, F.struct("subset", "n"))))
    parts = subset_survivors(judged).groupBy("part").agg(*[of(i).alias(c) for i, c in enumerate(("all", "good", "toxic"))])
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            after = before | 1 << f
            name = "".join(FILTERS[g] for g in order)
            steps.append(F.struct(F.lit(name).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(before).alias("before"), F.lit(after).alias("after"), F.lit(1 << f).alias("own")))
            before = after
    n = lambda subset, of="all": F.element_at(of, subset)
    lost = lambda of="all": n(F.col("before"), of) - n(F.col("after"), of)
    every = (1 << len(FILTERS)) - 1
    # A filter comes after just the set S in |S|! (4 - |S|)! orders.
    shapley = sum(
        F.when((F.col("own").bitwiseAND(s)) == 0, F.lit(factorial(s.bit_count()) * factorial(4 - s.bit_count())) * (n(F.lit(s)) - n(F.col("own").bitwiseOR(s)))).otherwise(0)
        for s in range(every)
        if s.bit_count() < 5
    )
    return parts.select("*", F.inline(F.array(*steps))).select(
        "part", "filter_order", "step", n(F.col("after")).alias("kept"), lost().alias("removed"),
        (n(F.lit(0)) - n(F.col("own")) - lost()).alias("redundant"), (n(F.lit(every) - F.col("own")) - n(F.lit(every))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.cast("long").alias("shapley"),
    )
