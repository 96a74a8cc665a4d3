"""Byte-level BPE encoding and decoding that encodes what documents share once.

Texts are cut where a rolling hash of the next bytes says so, so that equal passages are cut alike. Chunks that at least two
documents hold are encoded once each, wherever they are; what a document has alone is encoded in its place. Where stretches
meet, the last pieces of the left one are encoded again with the first of the right one, and further ones until both agree
on where a piece begins: from there on the right one's ids hold.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .packing import _Ids
from .words import blocks, hash_words, utf8

#: Bytes that the rolling hash covers, and chunks' mean, least and greatest size, of which two bytes can tell any place.
WINDOW, MEAN, LEAST, MOST = 32, 512, 64, 4096
#: Bits of the table that tells which chunks may be shared: 4 MB as broadcast whatever the input. A full table only moves more.
BITS = 25
#: A chunk with more than this part of all shared places is sent to all tasks; there are fewer than HEAVY of them.
HEAVY = 200
#: Bytes after a place that can decide whether a piece begins there.
_MARGIN = 16
_LETTER, _NUMBER, _OTHER, _WHITE = 1, 2, 3, 4
#: Bytes of texts whose pieces are looked up at once.
_BLOCK = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20

def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE, _SEGMENT + WINDOW), _powers(pow(_BASE, -1, 1 << 64), _SEGMENT)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _marks(data: np.ndarray) -> np.ndarray:
    """Places where the rolling hash of the next ``WINDOW`` bytes falls into one of ``MEAN`` classes, none soon after another."""
    found = []
    for lo in range(0, len(data) - WINDOW + 1, _SEGMENT):
        part = data[lo : lo + _SEGMENT + WINDOW - 1]
        n = len(part) - WINDOW + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * _POWER[: len(part)], dtype=np.uint64)])
        rolling = (sums[WINDOW : WINDOW + n] - sums[:n]) * _INVERSE[:n] * np.uint64(0xD6E8FEB86659FD93)
        found.append(lo + np.flatnonzero(((rolling >> np.uint64(40)) % np.uint64(MEAN) == 0) & ((part[:n] & 0xC0) != 0x80)))
    marks = np.concatenate(found) if found else np.zeros(0, np.int64)
    return marks[np.diff(marks, prepend=-LEAST) >= LEAST]


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, ends)`` of the chunks of a block of texts, in order; whole characters each, at most ``MOST`` bytes and a few."""
    marks = _marks(data)
    text = np.searchsorted(offsets, marks, "right") - 1
    marks = marks[marks + WINDOW <= offsets[text + 1]]
    bounds = np.unique(np.concatenate([offsets, marks]))
    gap = np.diff(bounds)
    far = np.flatnonzero(gap > MOST)
    more = [np.arange(a + MOST, b, MOST) for a, b in zip(bounds[far], bounds[far + 1], strict=True)]
    if more:
        extra = np.concatenate(more)
        while (inside := (data[extra] & 0xC0) == 0x80).any():
            extra[inside] -= 1
        bounds = np.unique(np.concatenate([bounds, extra]))
    return bounds[:-1], bounds[1:]


class _Bpe(_Ids):
    """A tokenizer in a worker, with the ids of the pieces it met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        split = config["pre_tokenizer"] or {}
        added = config["added_tokens"]
        if (
            split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or config["normalizer"] or config["post_processor"]
            or config["model"].get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added)
        ):
            raise ValueError(f"{path}: only byte-level BPE with the usual pattern and plain special tokens is supported")
        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.whole, self.tokenizer):
            t.no_truncation()
            t.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.special = [t["content"].encode() for t in added]
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.few: dict[str, np.ndarray] = {}
        self._start()
        # Bytes that print stand for themselves in the vocabulary, the others for the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.kept_as = "<u2" if len(tokens) <= 1 << 16 else "<u4"  # ids of shared chunks, when they move
        self.width = np.array([len(t) for t in tokens])
        self.place = np.cumsum(self.width) - self.width
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        (self.feed,) = self.encode_whole(b"\n").tolist()
        self.kind = np.zeros(0x110000, np.uint8)
        self._meet(np.arange(128))

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        """Ids of pieces. Those that aren't white space are encoded many at a time with line feeds between them, which neither
        change how the others are split nor join any of them."""
        out: list = [None] * len(words)
        inked = [i for i, w in enumerate(words) if self.kind[ord(w[w[0] == " " and len(w) > 1])] != _WHITE and "\n" not in w]
        for lo in range(0, len(inked), 4096):
            part = inked[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([words[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
            if len(ends) == len(part):
                for i, a, b in zip(part, [-1, *ends], ends, strict=False):
                    out[i] = ids[a + 1 : b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4")
        return out

    def _meet(self, points: np.ndarray) -> None:
        """What the tokenizer takes characters for: letters, numbers and others join their like, white space is left."""
        for c in points.tolist():
            kinds = [k for k, like in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(self.split(like + chr(c))) == 1]
            self.kind[c] = kinds[0] if kinds else _WHITE

    def piece_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where the pieces of a block of texts begin: contractions, runs of letters, of numbers and of others, each
        with one blank before it, and of white space."""
        n = len(data)
        at = np.arange(n)
        lead = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, at, 0))
        kind = self.kind[data & 0x7F]
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            first = data[wide].astype(np.int64)
            more = 1 + (first >= 0xE0) + (first >= 0xF0)
            point = first & (0x3F >> more)
            for k in (1, 2, 3):
                follow = more >= k
                point[follow] = (point[follow] << 6) | (data[wide[follow] + k] & 0x3F)
            met = np.unique(point)
            self._meet(met[self.kind[met] == 0])
            kind[wide] = self.kind[point]
            kind = kind[lead]
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        start = begin[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero(start[1:] & ~begin[1:n] & (kind[:-1] == _WHITE)) + 1
        start[lead[after - 1]] = True
        start[after[data[after - 1] == 32]] = False
        quote = np.flatnonzero(start & (data == 39))
        if len(quote):
            end = offsets[np.searchsorted(offsets, quote, "right")]
            one, two = data[np.minimum(quote + 1, n - 1)], data[np.minimum(quote + 2, n - 1)]
            short = (quote + 1 < end) & np.isin(one, list(b"stmd"))
            long = (quote + 2 < end) & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
            for q, e, size in ((quote[short], end[short], 2), (quote[long], end[long], 3)):
                start[q + 1] = False
                start[(q + size)[q + size < e]] = True
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, starts, before)`` of a block of texts: ids, where pieces begin, and how many ids are before each."""
        start = self.piece_starts(data, offsets)
        slot = self.slots(data, start, np.diff(np.append(start, len(data))))
        n = self.size[slot]
        before = np.cumsum(n) - n
        return self.ids[np.repeat(self.at[slot] - before, n) + np.arange(int(n.sum()))], start, before

    def window(self, text: bytes) -> list[tuple[int, str]]:
        """Byte sizes and texts of the pieces of a short text, by the tokenizer itself."""
        whole = text.decode()
        return [(len(mapped), whole[a:b]) for mapped, (a, b) in self.split(whole)]

    def few_ids(self, pieces: list[str]) -> list[np.ndarray]:
        if len(self.few) > 100_000:
            self.few.clear()
        new = list({p for p in pieces if p not in self.few})
        if new:
            self.few.update(zip(new, self._learn(new), strict=True))
        return [self.few[p] for p in pieces]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        width = self.width[ids]
        at = np.cumsum(width) - width
        return self.letters[np.repeat(self.place[ids] - at, width) + np.arange(int(width.sum()))]

    def encode_whole(self, text: bytes) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")


_workers: dict[str, _Bpe] = {}


def _bpe(path: str) -> _Bpe:
    if path not in _workers:
        _workers[path] = _Bpe(path)
    return _workers[path]


def encode_texts(bpe: _Bpe, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of each text. What does not decode to the text, and texts that spell out special tokens, are left to the tokenizer."""
    out: list[np.ndarray] = []
    sizes = np.array([len(t) for t in texts], np.int64)
    for lo, hi in blocks(np.concatenate([[0], np.cumsum(sizes)]), _BLOCK):
        raw = b"".join(texts[lo:hi])
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes[lo:hi])])
        ids, start, before = bpe.encode(data, offsets)
        bounds = np.append(before, len(ids))[np.searchsorted(start, offsets)]
        parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if any(s in raw for s in bpe.special) or not np.array_equal(bpe.decode(ids), data):
            for i, text in enumerate(texts[lo:hi]):
                if any(s in text for s in bpe.special) or bpe.decode(parts[i]).tobytes() != text:
                    parts[i] = bpe.encode_whole(text)
        out += parts
    return out


class Stretch:
    """A part of a text encoded on its own: its bytes, where its pieces begin, and how many ids are before each."""

    __slots__ = ("text", "ids", "starts", "before", "safe")

    def __init__(self, text: bytes, ids: np.ndarray, starts: np.ndarray, before: np.ndarray):
        self.text, self.ids, self.starts, self.before = text, ids, starts, before
        # The first so many begin far enough from the end to be judged by this text alone.
        self.safe = int(np.searchsorted(starts, len(text) - _MARGIN, "right"))


def stretches(bpe: _Bpe, texts: list[bytes]) -> list[Stretch]:
    out: list[Stretch] = []
    sizes = np.array([len(t) for t in texts], np.int64)
    for lo, hi in blocks(np.concatenate([[0], np.cumsum(sizes)]), _BLOCK):
        offsets = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
        ids, start, before = bpe.encode(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offsets)
        at, before = np.searchsorted(start, offsets), np.append(before, len(ids))
        for i, text in enumerate(texts[lo:hi]):
            a, b = at[i], at[i + 1]
            out.append(Stretch(text, ids[before[a] : before[b]], start[a:b] - offsets[i], before[a:b] - before[a]))
    return out


def join_stretches(bpe: _Bpe, parts: list[Stretch]) -> np.ndarray:
    """The ids of the stretches' joined text. What is pending is the text from a true beginning of a piece on."""
    out, pending = [np.zeros(0, "<u4")], b""
    for right in parts:
        agreed, width, size = None, 16, len(right.text)
        if not pending and right.safe:
            agreed = 0
        while agreed is None and size:
            cut = min(width, size)
            while cut < size and right.text[cut] & 0xC0 == 0x80:
                cut += 1
            window = pending + right.text[:cut]
            pieces = bpe.window(window)
            at = last = 0
            for k, (n, _) in enumerate(pieces):
                if at + _MARGIN > len(window):
                    break
                last, begin = k, at
                own = at - len(pending)
                j = int(np.searchsorted(right.starts[: right.safe], own)) if own >= 0 else right.safe
                if j < right.safe and right.starts[j] == own:
                    agreed = j
                    break
                at += n
            if agreed is not None:
                out += bpe.few_ids([p for _, p in pieces[:last]])
            elif cut == size:
                out += bpe.few_ids([p for _, p in pieces[:last]])
                pending = window[begin:] if last else window
                break
            width *= 4
        if agreed is not None:
            end = right.safe - 1
            out.append(right.ids[right.before[agreed] : right.before[end]])
            pending = right.text[int(right.starts[end]) :]
    out += bpe.few_ids([p for _, p in bpe.window(pending)])
    return np.concatenate(out).astype("<u4")


def assemble_texts(bpe: _Bpe, texts: list[tuple[list[bytes], list[int], dict[int, tuple[bytes, bytes, bytes]]]]) -> list[np.ndarray]:
    """Ids of texts, each as its chunks, their names and what is known of chunks by name: ids, pieces' beginnings, ids before.

    An entry that does not decode to its chunk is not used.
    """
    plans, own = [], []
    for chunks, names, known in texts:
        plan: list[Stretch | int] = []
        alone: list[bytes] = []
        for chunk, name in zip([*chunks, b""], [*names, None], strict=True):
            entry = known.get(name) if name is not None else None
            part = Stretch(chunk, *(np.frombuffer(x, kind) for x, kind in zip(entry, (bpe.kept_as, "<u2", "<u2"), strict=True))) if entry else None
            if part is not None and bpe.decode(part.ids).tobytes() != chunk:
                part = None
            if part is None and name is not None:
                alone.append(chunk)
                continue
            if alone:
                plan.append(len(own))
                own.append(b"".join(alone))
                alone = []
            if part is not None:
                plan.append(part)
        plans.append(plan)
    done, out = stretches(bpe, own), []
    for (chunks, _, _), plan in zip(texts, plans, strict=True):
        text = b"".join(chunks)
        ids = join_stretches(bpe, [done[x] if isinstance(x, int) else x for x in plan])
        if any(s in text for s in bpe.special) or bpe.decode(ids).tobytes() != text:
            ids = bpe.encode_whole(text)
        out.append(ids)
    return out


def _chunked(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a text column: rows from and to, bytes, starts, ends and names of chunks, and each row's first chunk."""
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets, most):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end = chunk_ends(part, own) if len(part) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield lo, hi, part, start, end, hash_words(part, start, end - start), np.searchsorted(start, own)


def shared_chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h, n)``: names of chunks, 64-bit hashes, that at least two documents hold."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _, _, h, first in _chunked(batch.column(0)):
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                h, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select(text_col).mapInArrow(names, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def _table(names: DataFrame, bits: int) -> np.ndarray:
    """A bit for each name's last ``bits`` bits; this table of fixed size is what reaches the driver."""
    low = F.col("h").bitwiseAND((1 << bits) - 1)
    words = names.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    found = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return table


def _may_be_shared(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(len(table) * 64 - 1)
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, texts: bool = False) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``texts`` also ``ids`` and ``decoded``.

    Ids are the tokenizer's for the whole text without special tokens added (those that a text spells out count), the decoded
    text is that of the ids. A null text is empty, without ids; repeated rows and ids are documents of their own; an empty
    table gives no rows.

    Texts without a chunk that may be shared are done where they are read. The others are stored, their shared chunks are
    encoded once each and joined to the documents by name, those of very many documents as a small table for all tasks.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    shared = staged(shared_chunks(docs, text_col), "shared")
    table = spark.sparkContext.broadcast(_table(shared, bits))
    fields = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else [])]
    types = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if texts else "")

    def digest(bpe: _Bpe, ids: np.ndarray) -> tuple:
        raw, back = ids.astype("<u4").tobytes(), bpe.decode(ids).tobytes().decode("utf-8", "replace")
        row = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        return (*row, raw, back) if texts else row

    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()][: len(fields)]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            for lo, hi, part, start, end, h, first in _chunked(batch.column(1), _BLOCK):
                may = np.add.reduceat(np.append(_may_be_shared(table.value, h), False), first[:-1]) * (np.diff(first) > 0)
                raw = part.tobytes()
                whole = [raw[start[a] : end[b - 1]] if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                done = iter(encode_texts(bpe, [t for t, m in zip(whole, may, strict=True) if not m]))
                rows = [(*[None] * len(fields), t.decode()) if m else (*digest(bpe, next(done)), None) for t, m in zip(whole, may, strict=True)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *(pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()], strict=True))], ["id", *fields, "text"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    first = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(alone, f"id {kind}, {types}, text string")
    first = staged(first.withColumn("row", F.monotonically_increasing_id()), "encoded")
    mixed = first.where("text is not null").select("row", "id", "text")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part, start, end, h, _ in _chunked(batch.column(0)):
                names, at = np.unique(h, return_index=True)
                keep = _may_be_shared(table.value, names)
                raw = part.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[keep].view(np.int64)), pa.array([raw[start[i] : end[i]].decode() for i in at[keep]], pa.string())], ["h", "text"]
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            parts = stretches(bpe, [t.encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.ids.astype(bpe.kept_as).tobytes() for p in parts], pa.binary()),
                 *(pa.array([getattr(p, c).astype("<u2").tobytes() for p in parts], pa.binary()) for c in ("starts", "before"))],
                ["h", "ids", "starts", "before"],
            )

    entry = "h long, ids binary, starts binary, before binary"
    book = staged(mixed.select("text").mapInArrow(hold, "h long, text string").groupBy("h").agg(F.min("text").alias("text")).mapInArrow(encode, entry), "book")
    places = shared.agg(F.sum("n")).first()[0] or 0
    heavy = shared.where(F.col("n") * HEAVY > places).select("h")
    known = book.join(F.broadcast(heavy), "h").toArrow().to_pylist()
    known = spark.sparkContext.broadcast({r["h"]: (r["ids"], r["starts"], r["before"]) for r in known})

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.array(sorted(known.value), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, _, _, _, h, first in _chunked(batch.column(1)):
                row = np.repeat(ids[lo:hi], np.diff(first))
                keep = _may_be_shared(table.value, h) & ~np.isin(h.view(np.int64), sent)
                pairs = np.unique(np.stack([row[keep], h[keep].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["row", "h"])

    named = mixed.select("row", "text").mapInArrow(name, "row long, h long").join(book, "h")
    lists = named.groupBy("row").agg(F.collect_list(F.struct("h", "ids", "starts", "before")).alias("entries"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            for lo, hi, part, start, end, h, first in _chunked(batch.column(1), _BLOCK):
                raw, names, held = part.tobytes(), h.view(np.int64).tolist(), []
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    entries = {e["h"]: (e["ids"], e["starts"], e["before"]) for e in batch.column(2)[lo + i].as_py() or ()}
                    entries |= {n: known.value[n] for n in names[a:b] if n in known.value}
                    chunks = [raw[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                    held.append((chunks, names[a:b], entries))
                rows = [digest(bpe, ids) for ids in assemble_texts(bpe, held)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *fields])

    rest = mixed.join(lists, "row", "left").select("id", "text", "entries").mapInArrow(assemble, f"id {kind}, {types}")
    return first.where("text is null").select("id", *fields).unionByName(rest).withColumnRenamed("id", id_col)
