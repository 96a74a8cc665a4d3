"""Importance resampling to a target distribution: hashed word runs, bucket gains, Gumbel top-k without replacement.

Buckets come from the CRC-32 of a feature's bytes. A CRC is linear, so each byte adds (by exclusive or) what a table holds
for the byte and its distance from the feature's end, and the length adds a constant: all features of a block of texts are
hashed by one table look-up and one ``bitwise_xor.reduceat``. Spans longer than the table fold into a state block by block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import running_sum
from .common import staged
from .words import blocks, utf8

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Words from which a document may be drawn, and the share of those documents that is.
LEAST, SHARE = 20, (10, 100)
#: Distances from the end that the table covers.
REACH = 64
#: Bytes of features that are hashed at a time.
SLICE = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.zeros(256, bool)
_INK[48:58] = _INK[97:123] = _INK[128:] = True


def _position_table(reach: int) -> np.ndarray:
    """Row d: what each byte adds to the CRC when d bytes follow it."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = (row >> 1) ^ np.where(row & 1, np.uint32(0xEDB88320), np.uint32(0))
    rows = [row]
    for _ in range(reach - 1):
        rows.append((rows[-1] >> 8) ^ row[rows[-1] & 255])
    return np.stack(rows)


_TABLE = _position_table(REACH)
#: The CRC of as many zero bytes: what initial and final inversion add to a feature of that length.
_LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


def _fold(data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state after one block of ``size`` (1 to REACH) bytes each: its first four bytes take up the state before it."""
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    byte = data[np.repeat(start, size) + place].astype(np.uint32)
    old = np.repeat(state, size)
    byte ^= np.where(place < 4, (old >> (8 * np.minimum(place, 3)).astype(np.uint32)) & 255, 0).astype(np.uint32)
    raw = np.bitwise_xor.reduceat(_TABLE[np.repeat(size, size) - 1 - place, byte], at)
    return raw ^ (state.astype(np.uint64) >> (8 * np.minimum(size, 4)).astype(np.uint64)).astype(np.uint32)


def span_crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span of bytes, spans may overlap; an empty span has 0."""
    out = np.zeros(len(start), np.uint32)
    short = np.flatnonzero((size > 0) & (size <= REACH))
    if len(short):
        s, n = start[short], size[short]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        parts = _TABLE[np.repeat(n, n) - 1 - place, data[np.repeat(s, n) + place]]
        out[short] = np.bitwise_xor.reduceat(parts, at) ^ _LENGTH[n]
    live = np.flatnonzero(size > REACH)
    state, done = np.full(len(live), 0xFFFFFFFF, np.uint32), 0
    while len(live):
        take = np.minimum(size[live] - done, REACH)
        state = _fold(data, start[live] + done, take, state)
        done += REACH
        ended = size[live] <= done
        out[live[ended]] = ~state[ended]
        live, state = live[~ended], state[~ended]
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(joined, size, text)``: all words in lower case with a blank after each, their sizes and texts."""
    data = _LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    ink = _INK[data]
    begin, end = ink.copy(), ink.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    end[:-1] &= ~ink[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    size = np.flatnonzero(end) + 1 - start
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    blank = np.zeros(len(joined), bool)
    blank[np.cumsum(size + 1) - 1] = True
    joined[~blank] = data[ink]
    return joined, size, np.searchsorted(offsets, start, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, bucket)`` of all runs of 1 to ``longest`` words of a block of texts, by text within a slice."""
    joined, size, text = _words(data, offsets)
    start = np.cumsum(size + 1) - size - 1
    for n in range(1, longest + 1):
        m = len(size) - n + 1
        if m <= 0:
            return
        same = np.flatnonzero(text[:m] == text[n - 1 :])
        begin, span = start[same], start[same + n - 1] + size[same + n - 1] - start[same]
        for lo, hi in blocks(np.concatenate([[0], np.cumsum(span)]), SLICE):
            yield text[same[lo:hi]], (span_crc32(joined, begin[lo:hi], span[lo:hi]) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over all texts; a task sends its sums only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in blocks(offsets):
                for _, bucket in features(data, offsets[lo : hi + 1], longest, buckets):
                    n += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met])], ["bucket", "n"])

    return texts.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the logarithm of how much likelier each bucket is in ``target``, floored. Two counts a bucket reach the driver."""
    both = bucket_counts(docs, text_col, longest, buckets).withColumn("of", F.lit(0)).unionByName(
        bucket_counts(target, text_col, longest, buckets).withColumn("of", F.lit(1))
    )
    counts = np.zeros((2, buckets), np.int64)
    for row in both.collect():
        counts[row["of"], row["bucket"]] = row["n"]
    (s, t), (S, T) = counts.tolist(), counts.sum(axis=1).tolist()
    return np.array(
        [math.floor(1000 * math.log((float(b + 1) * float(S + buckets)) / (float(a + 1) * float(T + buckets)))) for a, b in zip(s, t, strict=True)],
        np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """``(id, n_words, n_features, weight)``: the floored mean of the gains of a text's features, 0 without any."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            words, count, total = (np.zeros(len(offsets) - 1, np.int64) for _ in range(3))
            for lo, hi in blocks(offsets):
                own = offsets[lo : hi + 1]
                for k, (text, bucket) in enumerate(features(data, own, longest, buckets)):
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    at = np.searchsorted(text, np.arange(hi - lo + 1))
                    count[lo:hi] += np.diff(at)
                    total[lo:hi] += np.diff(sums[at])
                _, _, text = _words(data, own) if longest > 1 else (None, None, None)
                words[lo:hi] = np.bincount(text, minlength=hi - lo) if longest > 1 else count[lo:hi]
            weight = total // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(count), pa.array(weight)], ["id", "n_words", "n_features", "weight"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(rate, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate from the hash of seed and id (null as empty), floored: the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    least: int = LEAST, share: tuple[int, int] = SHARE, seed: int = SEED,
) -> DataFrame:
    """One row per document: id, ``n_features``, ``weight``, ``score``, ``rank`` (null if not drawn).

    Of the documents with at least ``least`` words the ``share`` with the highest weight plus Gumbel noise is drawn, ties to
    the smaller id, null ids last: a sample without replacement by importance. Null and empty texts have no features and
    weight 0; repeated rows are documents of their own and take ranks each. An empty target only smooths; an empty table
    gives no rows.

    Scores are whole numbers of a range that the logarithms bound (some 100,000), so a count of each finds the score from which
    documents are drawn; only those are ordered, by ranges.
    """
    gains = bucket_gains(docs, target, text_col, longest, buckets)
    scored = weigh(docs, gains, id_col, text_col, longest).withColumn("score", F.col("weight") + gumbel("id", seed))
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    may = F.col("n_words") >= least
    n = scored.where(may).count() * share[0] // share[1]
    by_score = scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("k"))
    above = F.sum("k").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    cut = by_score.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < n).agg(F.min("score")).first()[0] if n else None
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*columns, none)
    order = [F.desc("score"), F.col("id").asc_nulls_last(), "n_features", "weight", "row"]
    high = running_sum(scored.where(may & (F.col("score") >= cut)), order, F.lit(1).cast("long"), "rank")
    rest = scored.where(~(may & (F.col("score") >= cut)))
    return high.select(*columns, F.when(F.col("rank") <= n, F.col("rank")).alias("rank")).unionByName(rest.select(*columns, none))
