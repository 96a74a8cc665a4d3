"""Best-fit packing of token sequences with three capacities: tokens, documents and attention cost."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .words import blocks, hash_words, utf8

TOKENS = 2048
#: Documents of a sequence, and its attention cost, the sum of squared lengths. At these values the tokens bind first.
DOCUMENTS, COST = 2048, 2048 * 2048
#: Weights of the capacities in the norm of what a sequence has left.
WEIGHTS = (1.0, 0.05, 0.2)
#: Tokens and pieces of what a task packs; the last sequences of each task are all that packing apart can waste.
GROUP, PIECES = 20_000_000, 200_000
#: Strings and ids that a worker keeps; those that were not met for longest go first.
_KEPT, _KEPT_IDS = 2_000_000, 8_000_000
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, size, text)`` of the runs without blanks and line feeds in a block of texts that begins at 0."""
    ink = ~_BLANK[data]
    begin, end = ink.copy(), ink.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    end[:-1] &= ~ink[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1 - start, np.searchsorted(offsets, start, "right") - 1


class _Ids:
    """Ids of strings without blanks, computed on first sight and kept by the strings' 64-bit hashes.

    The tokenizer never joins characters over white space, so a text's ids are those of its strings in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.bar,) = self._encode("|")
        self._start()

    def _start(self) -> None:
        self.hash = np.zeros(0, np.uint64)  # in order
        self.at, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")
        self.round = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each. Short ones are encoded as one text with bars between them, which none of the words can give the id of."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if len(w) <= 64 and "|" not in w]
        for i in set(range(len(words))) - set(plain):
            out[i] = self._encode(words[i])
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            ids = self._encode(" | ".join([words[i] for i in part]))
            begin = 0
            for i, end in zip(part, [*np.flatnonzero(ids == self.bar).tolist(), len(ids)], strict=True):
                out[i] = ids[begin:end]
                begin = end + 1
        return out

    def slots(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the strings in ``at`` and ``size``; valid until the next call."""
        self.round += 1
        distinct, first, of = np.unique(hash_words(data, start, size), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, distinct)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == distinct[known]
        new = np.flatnonzero(~known)
        self.met[at[known]] = self.round
        if len(new):
            self._forget(len(new))
            raw = memoryview(data)
            spans = zip(start[first[new]].tolist(), size[first[new]].tolist(), strict=True)
            ids = self._learn([str(raw[a : a + n], "utf-8") for a, n in spans])
            sizes = np.array([len(x) for x in ids])
            hashes = np.concatenate([self.hash, distinct[new]])
            order = np.argsort(hashes, kind="stable")
            self.hash = hashes[order]
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])[order]
            self.size = np.concatenate([self.size, sizes])[order]
            self.met = np.concatenate([self.met, np.full(len(new), self.round)])[order]
            self.ids = np.concatenate([self.ids, *ids])
            at = np.searchsorted(self.hash, distinct)
        return at[of]

    def _forget(self, coming: int) -> None:
        if len(self.hash) + coming <= _KEPT and len(self.ids) <= _KEPT_IDS:
            return
        # What the current block needs stays; of the rest the half that was met last.
        age = np.sort(self.met)[len(self.met) // 2] if len(self.met) else 0
        keep = np.flatnonzero((self.met > age) | (self.met == self.round))
        size = self.size[keep]
        at = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.at[keep] - at, size) + np.arange(int(size.sum()))]
        self.hash, self.at, self.size, self.met = self.hash[keep], at, size, self.met[keep]


_cache: dict[str, _Ids] = {}


def _known(path: str) -> _Ids:
    """The ids that this worker has, from one task to the next."""
    if path not in _cache:
        _cache[path] = _Ids(path)
    return _cache[path]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = TOKENS) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each text's ids and a closing 0, cut after every ``most`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            # Strings are looked up for many texts at once, their ids are joined for few.
            for lo, hi in blocks(offsets, 1 << 23):
                part, own = np.ascontiguousarray(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                start, size, text = _strings(part, own)
                slot = known.slots(part, start, size)
                n_ids = known.size[slot]
                per_text = np.bincount(text, n_ids, minlength=hi - lo).astype(np.int64)
                count = np.bincount(text, minlength=hi - lo)
                word = np.concatenate([[0], np.cumsum(count)])
                rows = []
                for a, b in blocks(np.concatenate([[0], np.cumsum(per_text)]), 1 << 20):
                    s, n = slot[word[a] : word[b]], n_ids[word[a] : word[b]]
                    begin = np.cumsum(n) - n
                    ids = known.ids[np.repeat(known.at[s] - begin, n) + np.arange(int(n.sum()))]
                    ids = np.insert(ids, np.cumsum(per_text[a:b]), 0).astype("<u4")
                    view, at = memoryview(ids).cast("B"), 0
                    for i in range(a, b):
                        total = int(per_text[i]) + 1
                        for k, begin_ in enumerate(range(0, total, most)):
                            stop = min(begin_ + most, total)
                            rows.append((lo + i, k, begin_, stop - begin_, zlib.crc32(view[4 * (at + begin_) : 4 * (at + stop)])))
                        at += total
                t = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(t[:, 0])), pa.array(t[:, 1].astype(np.int32)), *(pa.array(np.ascontiguousarray(t[:, c])) for c in (2, 3, 4))],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(
    lengths: np.ndarray, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, weights=WEIGHTS
) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length. Longest first, each goes to the open bin that is left with the smallest weighted
    norm of residual capacities, among those that have room for it in every capacity; else a bin is opened."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((3, max(1, len(lengths))))
    names = np.zeros(max(1, len(lengths)), np.int64)
    n = opened = 0
    scale = np.array(weights) / np.array([tokens, documents, cost], float) ** 2
    least = int(lengths.min()) if len(lengths) else 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        open_ = left[:, :n]
        rest = open_ - need[:, None]
        fits = (rest >= 0).all(axis=0)
        if fits.any():
            score = scale @ (rest * rest)
            score[~fits] = np.inf
            b = int(np.argmin(score))
        else:
            b, n = n, n + 1
            left[:, b] = tokens, documents, cost
            names[b] = opened
            opened += 1
        where[i], offset[i] = names[b], tokens - left[0, b]
        left[:, b] -= need
        if left[0, b] < least or left[1, b] < 1 or left[2, b] < least * least:
            n -= 1  # full: the last open bin takes its place
            left[:, b], names[b] = left[:, n], names[n]
    return where, offset


def pack(
    pieces: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, weights=WEIGHTS, group: int = GROUP
) -> DataFrame:
    """``pieces`` (with a ``length`` of ``tokens`` at most) with ``sequence_id`` and ``offset``.

    A sequence has at most ``tokens`` tokens, ``documents`` pieces and a sum of squared lengths of ``cost``; a piece that
    alone costs more is a sequence of its own, as whole pieces are. The others are dealt evenly to tasks of about
    ``group`` tokens, whatever their keys, and each task packs its own: no task grows with the input.
    """
    pieces = staged(pieces, "pieces")
    full = pieces.where(F.col("length") >= tokens)
    rest = pieces.where(F.col("length") < tokens)
    total = rest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    tasks = max(1, -(-total["size"] // group), -(-total["n"] // PIECES))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            rows = pd.concat(held, ignore_index=True).sort_values(["length", "id", "piece"], ascending=[False, True, True])
            where, offset = best_fit(rows["length"].to_numpy(), tokens, documents, cost, weights)
            task = TaskContext.get().partitionId()
            yield rows.assign(sequence_id=((task << 33) + where) * 2, offset=offset)

    packed = rest.repartition(tasks).mapInPandas(fill, rest.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint")
    own = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(own)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null or empty text is the closing 0 alone. Repeated rows are packed each. An empty table gives no rows.
    """
    return pack(token_pieces(docs, path or tokenizer_path(), id_col, text_col)).withColumnRenamed("id", id_col)
