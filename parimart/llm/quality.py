"""Quality classifier: a factorisation machine over hashed words, structure statistics and text length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from .words import SPACE, Words, blocks, utf8

BITS, RANK = 16, 8
#: Labelled rows that the model is fitted on, at most: those with the smallest hash of the id.
SAMPLE = 4000
#: Score from which a document counts as good.
CUT = 0.7
STATISTICS = 16
_SIZE = (1 << BITS) + STATISTICS
_UPPER, _DIGIT, _MARK, _SYMBOL, _HIGH = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[[33, 44, 46, 58, 59, 63]] = True
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and c not in (33, 44, 46, 58, 59, 63)]] = True
_HIGH[128:] = True


def _statistics(w: Words, lines: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Rates and logarithms, each about 0 to 1, one row a text."""
    n_texts = len(w.offsets) - 1
    size = np.diff(w.offsets)
    of = np.repeat(np.arange(n_texts), size)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(w.count, 1)
    rate = [np.bincount(of[kind[w.data]], minlength=n_texts) * per_byte for kind in (_UPPER, _DIGIT, _MARK, _SYMBOL, _HIGH, SPACE)]

    def repeats(step: int) -> np.ndarray:
        same = (w.hash[step:] == w.hash[:-step]) & (w.text[step:] == w.text[:-step])
        return np.bincount(w.text[step:][same], minlength=n_texts) * per_word

    last = w.data[np.maximum(w.end - 1, 0)]
    letters = w.end - w.start
    by_word = lambda x: np.bincount(w.text[x], minlength=n_texts) * per_word
    out = np.stack(
        [
            *rate, distinct * per_word, repeats(1), by_word(_SYMBOL[last]), by_word(last == 33),
            by_word((letters == 1) & _SYMBOL[last]), by_word(letters > 20), np.log1p(w.count) / 8,
            np.minimum(np.bincount(w.text, letters, minlength=n_texts) * per_word / 10, 2), np.log1p(size * 1.0 / (lines + 1)) / 8,
            np.ones(n_texts),
        ],
        axis=1,
    )
    return out.astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, index, value)`` of a block of texts, sorted by row: word counts of unit length, then the statistics."""
    lines = np.add.reduceat(np.append(data[offsets[0] : offsets[-1]] == 10, 0), offsets[:-1] - offsets[0]) * (np.diff(offsets) > 0)
    w = Words(data, offsets)
    n_texts = len(offsets) - 1
    key, count = np.unique((w.text.astype(np.int64) << BITS) | (w.hash & np.uint64((1 << BITS) - 1)).astype(np.int64), return_counts=True)
    row = key >> BITS
    value = np.sqrt(count / np.maximum(w.count[row], 1)).astype(np.float32)
    s = _statistics(w, lines, np.bincount(row, minlength=n_texts))
    row = np.concatenate([row, np.repeat(np.arange(n_texts), STATISTICS)])
    index = np.concatenate([key & ((1 << BITS) - 1), np.tile(np.arange(1 << BITS, _SIZE), n_texts)])
    order = np.argsort(row, kind="stable")
    return row[order], index[order], np.concatenate([value, s.ravel()])[order]


class FactorisationMachine:
    """score = sigmoid(b + w.x + sum of <v_i, v_j> x_i x_j over pairs), in time linear in the features."""

    def __init__(self, seed: int = 5):
        self.bias, self.w = 0.0, np.zeros(_SIZE, np.float32)
        self.v = np.random.Generator(np.random.PCG64(seed)).normal(0, 0.05, (_SIZE, RANK)).astype(np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, l2: float = 1e-5) -> None:
        """AdaGrad on the logistic loss. Without rows nothing speaks against a text, and every score is near 0.98."""
        if not rows:
            self.bias, self.v = 4.0, np.zeros_like(self.v)
        gw, gv, gb = np.full(_SIZE, 1e-3, np.float32), np.full((_SIZE, RANK), 1e-3, np.float32), 1e-3
        shuffle = np.random.Generator(np.random.PCG64(6))
        for _ in range(epochs):
            for i in shuffle.permutation(len(rows)):
                ix, x = rows[i]
                vx = self.v[ix] * x[:, None]
                s = vx.sum(axis=0)
                z = self.bias + self.w[ix] @ x + 0.5 * (s @ s - (vx * vx).sum())
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
                dw = g * x + l2 * self.w[ix]
                dv = g * (x[:, None] * s - vx * x[:, None]) + l2 * self.v[ix]
                gb += g * g
                gw[ix] += dw * dw
                gv[ix] += dv * dv
                self.bias -= rate * g / np.sqrt(gb)
                self.w[ix] -= rate * dw / np.sqrt(gw[ix])
                self.v[ix] -= rate * dv / np.sqrt(gv[ix])

    def score(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts; every text has its statistics, so every row has entries."""
        at = np.searchsorted(row, np.arange(n))
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        pairs = 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), at))
        z = self.bias + np.add.reduceat(self.w[index] * value, at) + pairs
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def remainder(id_col: str):
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on ``sample`` labelled documents at most, none of them held out.

    The sampled documents' features are what the driver gathers: one row an id, whose number is bounded by ``sample``. Rows
    without a label are left out; of an id's labels the largest counts, of its texts the least. Ids are of any type.
    """
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
        .where(remainder("id") != 2)
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    whole = isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    place = F.col("id").cast("long") if whole else F.xxhash64("id")
    rows = found.groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(place.alias("id"), "y", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in blocks(offsets):
                row, index, value = features(data, offsets[lo : hi + 1])
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi].cast(pa.int32()),
                     pa.array([index[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                     pa.array([value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["id", "y", "index", "value"],
                )

    found = rows.mapInArrow(measure, "id long, y int, index binary, value binary").toArrow().to_pydict()
    order = sorted(range(len(found["id"])), key=lambda i: (found["id"][i], found["index"][i]))
    model = FactorisationMachine()
    model.fit(
        [(np.frombuffer(found["index"][i], "<i4"), np.frombuffer(found["value"][i], np.float32)) for i in order],
        np.array([found["y"][i] for i in order], float),
    )
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``cut``); names that clash are replaced.

    A row is scored by its text alone, null as empty. The model, 2.6 MB whatever the input, is broadcast; there is
    no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))
    docs = docs.drop("score", "predicted")
    names, at = docs.columns, docs.columns.index(text_col)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorisationMachine.__new__(FactorisationMachine)
        own.bias, own.w, own.v = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            parts = [own.score(*features(data, offsets[lo : hi + 1]), hi - lo) for lo, hi in blocks(offsets)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))], [*names, "score", "predicted"]
            )

    return docs.mapInArrow(rate, StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer"))
