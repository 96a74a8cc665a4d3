"""Line deduplication by an exact set-similarity join with prefix, positional and length filters.

A line is the set of its words. Words are ordered by rarity, so that of two similar lines the short prefixes of rarest
words must share one. Rarity comes from counts of all lines' words in a table of fixed size; the order affects the
number of candidates only, never the result. Where the rarest shared word is common itself, lines must share a second
one of a prefix longer by one, and meet by both. Candidates that pass the filters are verified by their Jaccard
similarity on the texts, and of each match the later line goes.

Prefixes move as packed arrays, a bucket of words at a time: a posting takes some 30 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from .common import release, staged
from .words import Words, blocks, mix, utf8

#: Similarity from which lines match, and distinct words from which a line is judged at all.
SIMILARITY, LEAST = (4, 5), 1
#: Counters of the rarity table: two rows of so many, 8 MB as broadcast whatever the input. Tasks send their own in slices.
SLOTS, SLICE = 1 << 22, 1 << 12
#: Lines with a word (as the tasks count them) from which it is paired with the next ones of the prefix.
COMMON = 20_000
#: Earlier partners that a line names per word at first (some more in one case); lines with more are looked at again if none
#: of these matches.
PARTNERS = 16
#: Postings of a bucket, about, and those that a task holds before it sends them.
BUCKET, HELD = 1_000_000, 400_000
#: Pairs of postings that a task looks at at once, sets of a key up to which each meets all others at first, and first lines
#: and neighbours on either side that it meets beyond.
PAIRS, FULL, HEADS = 1 << 20, 1 << 15, 32
_LOW = np.uint64(SLOTS - 1)
_NO_ID = 2**63 - 1
#: Where a line is, and its earlier partner: id and name of the row, and place in the text.
SPOT, OTHER = ["id", "sub", "place"], ["xid", "xsub", "xplace"]


class Lines:
    """The lines of a block of texts that are long enough, as sets of word hashes in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        base, part = offsets[0], data[offsets[0] : offsets[-1]]
        own = offsets - base
        breaks = np.flatnonzero(part == 10) + 1
        every = np.union1d(own, breaks)
        w = Words(part, every)
        room = max(1, len(every)).bit_length()
        key = (w.text.astype(np.uint64) << np.uint64(64 - room)) | (w.hash >> np.uint64(room))
        order = np.argsort(key)
        h, line = w.hash[order], w.text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        h, line = h[new], line[new]
        size = np.bincount(line, minlength=max(1, len(every) - 1))
        long = size >= least
        held = long[line]
        picked = np.flatnonzero(long)
        self.word, self.size = h[held], size[picked]
        self.line = np.repeat(np.arange(len(picked)), self.size)
        self.begin = np.cumsum(self.size) - self.size
        start = every[picked]
        self.text = np.searchsorted(own, start, "right") - 1
        self.place = np.searchsorted(breaks, start, "right") - np.searchsorted(breaks, own[self.text], "right")

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each set."""
        if not len(self.size):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        h, n = mix(self.word), self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(np.add.reduceat(h, self.begin) + n), mix(np.bitwise_xor.reduceat(h, self.begin) + n)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each set, every word flipping one: sets differ in no fewer words than bits."""
        bit = (self.word >> np.uint64(40)) % np.uint64(96)
        low = np.where(bit < 64, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        high = np.where(bit < 64, np.uint64(0), np.uint64(1) << (bit & np.uint64(31)))
        return np.bitwise_xor.reduceat(low, self.begin), np.bitwise_xor.reduceat(high, self.begin).astype(np.uint32)


def _lines(column: pa.Array, least: int) -> Iterator[tuple[int, Lines]]:
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets):
        yield lo, Lines(data, offsets[lo : hi + 1], least)


class _Seen:
    """Names met in this task; forgetting some only means that they are sent again."""

    def __init__(self) -> None:
        self.names: set[int] = set()

    def new(self, names: np.ndarray) -> np.ndarray:
        """Whether each is met for the first time."""
        out = np.zeros(len(names), bool)
        if len(self.names) > 200_000:
            self.names.clear()
        for i, name in enumerate(names.tolist()):
            if name not in self.names:
                self.names.add(name)
                out[i] = True
        return out


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & _LOW).astype(np.int64), SLOTS + ((h >> np.uint64(32)) & _LOW).astype(np.int64)


def _code(count: np.ndarray) -> np.ndarray:
    """Counts as one byte each: exact below 64, then four steps to each doubling, up to 2**53."""
    out = np.minimum(count, 64).astype(np.uint8)
    big = count >= 64
    out[big] = np.minimum(255, 64 + np.floor(4 * np.log2(count[big] / 64))).astype(np.uint8)
    return out


def _survey(least: int):
    """Occurrences of lines, and at the end of a task the word counts of the different lines in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = _Seen(), np.zeros(2 * SLOTS, np.int32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            word, n = np.unique(np.concatenate(waiting), return_counts=True)
            for at in _slots(word):
                np.add.at(table, at, n)
            waiting.clear()

        names = ["id", "sub", "place", "cls", "more", "n", "slice", "counts"]
        for batch in batches:
            for lo, lines in _lines(batch.column(1), least):
                cls, more = lines.names()
                waiting.append(lines.word[seen.new(cls)[lines.line]])
                if sum(map(len, waiting)) >= HELD:
                    count()
                n, of = len(cls), pa.array(lo + lines.text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(2).take(of), pa.array(lines.place.astype(np.int32)), pa.array(cls.view(np.int64)),
                     pa.array(more.view(np.int64)), pa.array(lines.size.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names,
                )
        if waiting:
            count()
        used = np.flatnonzero(table)
        of = used // SLICE
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(used) else np.zeros(0, np.int64)
        parts = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(used)], strict=True) if len(used) else ():
            parts.append((used[a:b] % SLICE).astype("<u2").tobytes() + table[used[a:b]].astype("<u4").tobytes())
        n = len(parts)
        blank = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(of[at].astype(np.int32)), pa.array(parts, pa.binary())], names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' counters as codes."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(c) // 6
            sums = total.setdefault(s, np.zeros(SLICE, np.int64))
            sums[np.frombuffer(c, "<u2", n)] += np.frombuffer(c, "<u4", n, 2 * n)
    coded = [_code(t).tobytes() for t in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(coded, pa.binary())], ["slice", "counts"])


def _rarity(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _slots(h)
    return np.minimum(table[a], table[b])


def _prefixes(lines: Lines, rare: np.ndarray, ok: np.ndarray, num: int, den: int, common: int) -> tuple[np.ndarray, ...]:
    """``(key, line, rank, splits)`` of the keys of each line that is ``ok``.

    ``lines.word`` in order of rarity within each line comes with its codes. Words counted once are in no other line.
    A word of code ``common`` or more is paired with every later one of a prefix longer by one, as lines that match have
    two words in common if more than half must be; so one of the pairs is that of their two rarest shared words. A pair of
    words that may be in several buckets' worth of lines is split over as many.
    """
    rank = np.arange(len(rare)) - lines.begin[lines.line]
    first = lines.size - -(-num * lines.size // den) + 1
    in_prefix = ok[lines.line] & (rank < first[lines.line])
    single = in_prefix & (rare > 1)
    if 2 * num <= den:
        common = 256
    hot = np.flatnonzero(single & (rare >= common))
    single &= rare < common
    at = np.flatnonzero(single)
    keys, of, ranks, splits = [mix(lines.word[at])], [lines.line[at]], [rank[at]], [np.ones(len(at), np.int64)]
    if len(hot):
        last = np.minimum(first[lines.line[hot]], lines.size[lines.line[hot]] - 1)  # its rank in the longer prefix
        span = last - rank[hot]
        x = np.repeat(hot, span)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(span) - span, span)
        keys.append(mix(mix(lines.word[x]) + lines.word[y]))
        of.append(lines.line[x])
        ranks.append(rank[x])
        splits.append(np.ceil(64 * 2.0 ** ((rare[x].astype(float) - 64) / 4) / BUCKET).astype(np.int64))
    return np.concatenate(keys), np.concatenate(of), np.concatenate(ranks), np.concatenate(splits)


#: Columns of packed postings after the table of rows, with their types.
_COLUMNS = [("key", "<u4"), ("name", "<u4"), ("low", "<u8"), ("high", "<u4"), ("row", "<u4"), ("place", "<u4"), ("n", "<u4"), ("at", "<u4"), ("splits", "<u4")]
#: Those that fit two bytes mostly, and then take no more.
_SHORT = ("row", "place", "n", "at", "splits")


def _packed(t: dict[str, np.ndarray], ids: np.ndarray, subs: np.ndarray) -> bytes:
    used, row = np.unique(t["row"], return_inverse=True)
    wide = {c: (t[c] if c != "row" else row).max() >= 1 << 16 for c in _SHORT}
    head = [len(used), len(row), *wide.values()]
    body = [(row if c == "row" else t[c]).astype(k if wide.get(c, True) else "<u2").tobytes() for c, k in _COLUMNS]
    return b"".join([np.array(head, "<i4").tobytes(), ids[used].tobytes(), subs[used].tobytes(), *body])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    head = np.frombuffer(blob, "<i4", 2 + len(_SHORT)).tolist()
    rows, n, wide, at = head[0], head[1], dict(zip(_SHORT, head[2:], strict=True)), 4 * (2 + len(_SHORT))
    ids, subs = np.frombuffer(blob, "<i8", rows, at), np.frombuffer(blob, "<i8", rows, at + 8 * rows)
    at, out = at + 16 * rows, {}
    for c, kind in _COLUMNS:
        kind = np.dtype(kind if wide.get(c, True) else "<u2")
        out[c] = np.frombuffer(blob, kind, n, at)
        at += kind.itemsize * n
    return ids, subs, out


def _postings(held, least: int, num: int, den: int, buckets: int, asked: bool = False):
    """Packed postings by bucket of their key, of the first line of each set in a task.

    A set so small that it matches only equal ones needs none. With ``asked`` a column of places says which lines are meant;
    their postings go to every bucket that has a part of their key.
    """
    n = np.arange(den * (num + den))
    alone = (den * n // num == n) & (-(-num * n // den) == n) & (den * (n - 1) < num * (n + 1))
    larger = int(np.argmin(alone))  # from this size on, others may match
    common = int(_code(np.array([COMMON]))[0])

    def send(parts: list[dict[str, np.ndarray]], ids: np.ndarray, subs: np.ndarray) -> pa.RecordBatch:
        t = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        order = np.argsort(t["bucket"], kind="stable")
        t = {c: x[order] for c, x in t.items()}
        at = np.flatnonzero(np.concatenate([[True], t["bucket"][1:] != t["bucket"][:-1]])) if len(order) else np.zeros(0, int)
        ends = [*at[1:].tolist(), len(order)]
        blobs = [_packed({c: x[a:b] for c, x in t.items()}, ids, subs) for a, b in zip(at.tolist(), ends, strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(t["bucket"][at].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = held.value, _Seen()
        for batch in batches:
            ids, subs = (batch.column(i).to_numpy() for i in (0, 2))
            meant = batch.column(3).to_pylist() if asked else None
            parts, rows = [], 0
            for lo, lines in _lines(batch.column(1), least):
                if not len(lines.size):
                    continue
                code = _rarity(table, lines.word)
                # Within a line words already are in order of hash, which decides among equally rare ones.
                order = np.argsort((lines.line << 8) | code, kind="stable")
                name = lines.names()[0]
                low, high = lines.parities()
                lines.word = lines.word[order]
                if asked:
                    ok = np.array([p in meant[lo + i] for i, p in zip(lines.text.tolist(), lines.place.tolist(), strict=True)], bool)
                else:
                    ok = seen.new(name) & (lines.size >= larger)
                key, of, rank, splits = _prefixes(lines, code[order], ok, num, den, common)
                splits = np.minimum(splits, buckets)
                if asked:
                    part = np.arange(int(splits.sum())) - np.repeat(np.cumsum(splits) - splits, splits)
                    key, of, rank, splits = (np.repeat(x, splits) for x in (key, of, rank, splits))
                else:
                    part = (name[of] >> np.uint64(32)).astype(np.int64) % splits
                bucket, key = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                bucket = (bucket + part) % buckets
                parts.append({
                    "bucket": bucket, "key": key, "name": (name & np.uint64(0xFFFFFFFF))[of],
                    "low": low[of], "high": high[of], "row": lo + lines.text[of], "place": lines.place[of], "n": lines.size[of], "at": rank, "splits": splits,
                })
                rows += len(key)
                if rows >= HELD:
                    yield send(parts, ids, subs)
                    parts, rows = [], 0
            if parts:
                yield send(parts, ids, subs)

    return run


def _bucket(blobs: list[bytes], probes: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """A bucket's postings, and ids and names of its rows in order; ``spot`` is a line's place among all of the bucket."""
    parts, shift = [], 0
    all_ids, all_subs = [], []
    for k, blob in enumerate([*blobs, *probes]):
        ids, subs, t = _unpacked(blob)
        t["probe"] = np.full(len(t["key"]), k >= len(blobs))
        parts.append({c: x.astype(np.int64) + shift if c == "row" else x for c, x in t.items()})
        all_ids.append(ids)
        all_subs.append(subs)
        shift += len(ids)
    t = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    ids, subs = np.concatenate(all_ids), np.concatenate(all_subs)
    order = np.lexsort((subs, ids))
    ids, subs = ids[order], subs[order]
    new = np.concatenate([[False], (ids[1:] != ids[:-1]) | (subs[1:] != subs[:-1])])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    first = np.flatnonzero(~np.concatenate([[False], ~new[1:]])) if len(new) else order
    t["spot"] = (rank[t.pop("row")].astype(np.uint64) << np.uint64(32)) | t.pop("place").astype(np.uint64)
    return t, ids[first], subs[first]


def _short(t: dict[str, np.ndarray]) -> np.ndarray:
    return np.minimum(t["n"], 0xFFFF).astype(np.int64)


def _distinct_sets(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Postings in order of (key, size, bits), of equal sets the earliest alone. ``order`` has key and size as one number."""
    short = _short(t).astype(np.uint64)
    order = np.lexsort((t["name"], (t["key"].astype(np.uint64) << np.uint64(32)) | (short << np.uint64(16)) | (t["low"] >> np.uint64(48))))
    t = {c: x[order] for c, x in t.items()}
    same = np.ones(len(order), bool)
    same[:1] = False
    for c in ("key", "n", "name", "low", "high"):
        same[1:] &= t[c][1:] == t[c][:-1]
    begin = np.flatnonzero(~same)
    out = {c: t[c][begin].astype(np.int64) for c in ("key", "n", "at", "splits")} | {c: t[c][begin] for c in ("low", "high")}
    out["spot"] = np.minimum.reduceat(t["spot"], begin) if len(begin) else t["spot"]
    out["order"] = (out["key"] << 16) | _short(out)
    return out


def _span(a: dict[str, np.ndarray], b: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of ``b`` that the length filter leaves each posting of ``a``."""
    short, key = _short(a), a["key"].astype(np.int64) << 16
    most = np.where(short == 0xFFFF, 0xFFFF, np.minimum(den * short // num, 0xFFFF))
    return np.searchsorted(b["order"], key | -(-num * short // den)), np.searchsorted(b["order"], key | most, "right")


def _each(of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each of ``of`` with every number from ``begin`` to ``end``."""
    size = end - begin
    return np.repeat(of, size), np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _passing(a: dict[str, np.ndarray], p: np.ndarray, b: dict[str, np.ndarray], q: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Of pairs of a posting with another the ones that pass length, positional and bit filter, with bits that differ and words that may."""
    n, m = a["n"][p].astype(np.int64), b["n"][q].astype(np.int64)
    need = -(-num * (n + m) // (num + den))
    ok = (num * np.maximum(n, m) <= den * np.minimum(n, m)) & (np.minimum(n - a["at"][p], m - b["at"][q]) >= need)
    p, q, room = p[ok], q[ok], (n + m - 2 * need)[ok]
    apart = np.bitwise_count(a["low"][p] ^ b["low"][q]).astype(np.int64) + np.bitwise_count(a["high"][p] ^ b["high"][q])
    ok = (apart <= room) & (a["spot"][p] != b["spot"][q])
    return p[ok], q[ok], apart[ok], room[ok]


def _walks(t: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(later, earlier, bits apart, words they may be apart, unseen)``: candidates, at most about ``PAIRS`` held at once.

    All of a posting's candidates as the later line come together. Keys with more than ``FULL`` sets, or that are split over
    buckets, are not walked whole: there a line meets the ``HEADS`` first lines and its neighbours in order of size and bits,
    and those in ``unseen`` have others.
    """
    n = len(t["key"])
    if not n:
        return
    start = np.flatnonzero(np.concatenate([[True], t["key"][1:] != t["key"][:-1]]))
    end = np.append(start[1:], n)
    every, none = np.arange(n), np.zeros(0, np.int64)
    lo, hi = _span(t, t, num, den)
    pairs = np.add.reduceat(every - lo, start)
    whole = (end - start <= FULL) & (t["splits"][start] == 1)
    small = whole & (pairs <= PAIRS)
    in_small = np.repeat(small, end - start)
    for a, b in blocks(np.concatenate([[0], np.cumsum(np.where(small, pairs, 0))]), PAIRS):
        own = start[a] + np.flatnonzero(in_small[start[a] : end[b - 1]])
        y, x = _each(own, lo[own], own)
        y, x, apart, room = _passing(t, y, t, x, num, den)
        later = t["spot"][y] > t["spot"][x]
        yield np.where(later, y, x), np.where(later, x, y), apart, room, none
    for r in np.flatnonzero(whole & ~small):
        for a, b in blocks(np.concatenate([[0], np.cumsum((hi - lo)[start[r] : end[r]])]), PAIRS):
            own = np.arange(start[r] + a, start[r] + b)
            p, q = _each(own, lo[own], hi[own])
            early = t["spot"][q] < t["spot"][p]
            yield *_passing(t, p[early], t, q[early], num, den), none
    for r in np.flatnonzero(~whole):
        spots = t["spot"][start[r] : end[r]]
        heads = start[r] + np.argpartition(spots, HEADS - 1)[:HEADS] if len(spots) > HEADS else np.arange(start[r], end[r])
        step = PAIRS // (3 * HEADS)
        for a in range(start[r], end[r], step):
            own = np.arange(a, min(a + step, end[r]))
            p, q = _each(own, np.maximum(own - HEADS, start[r]), np.minimum(own + HEADS + 1, end[r]))
            p, q = np.concatenate([p, np.repeat(own, len(heads))]), np.concatenate([q, np.tile(heads, len(own))])
            p, q = np.divmod(np.unique(p * n + q), n)
            early = t["spot"][q] < t["spot"][p]
            yield *_passing(t, p[early], t, q[early], num, den), own


def _candidates(num: int, den: int):
    """Rows in order of bucket: earlier candidates of lines, the nearest by their bits first.

    A line gets ``PARTNERS`` for each key, or four times as many if none is near; ``turn`` 0 has those to verify first, fewer
    the nearer they are, and 1 the others. If there are more, ``more`` says so (without a candidate if it met none), and the
    postings of the key come along once, packed again. Where a bucket has probes, these get all their earlier candidates.
    """
    names = ["bucket", *SPOT, *OTHER, "turn", "more", "blob"]
    kinds = (pa.int64(), pa.int64(), pa.int32())

    def rows(bucket: int, y: np.ndarray, x: np.ndarray | None, turn: np.ndarray, more: np.ndarray, ids: np.ndarray, subs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(y), 1 << 18):
            part, spots = slice(lo, lo + (1 << 18)), []
            for s in (y[part], None if x is None else x[part]):
                if s is None:
                    spots += [pa.nulls(len(y[part]), k) for k in kinds]
                    continue
                row = (s >> np.uint64(32)).astype(np.int64)
                spots += [pa.array(ids[row]), pa.array(subs[row]), pa.array((s & np.uint64(0xFFFFFFFF)).astype(np.int32))]
            n = len(spots[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, bucket, np.int32)), *spots, pa.array(turn[part]), pa.array(more[part]), pa.nulls(n, pa.binary())], names
            )

    def probe(bucket: int, t: dict[str, np.ndarray], ids: np.ndarray, subs: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = _distinct_sets({c: x[~t["probe"]] for c, x in t.items()})
        asked = {c: x[t["probe"]] for c, x in t.items()}
        lo, hi = _span(asked, sets, num, den)
        for a, b in blocks(np.concatenate([[0], np.cumsum(hi - lo)]), PAIRS):
            p, q = _each(np.arange(a, b), lo[a:b], hi[a:b])
            early = sets["spot"][q] < asked["spot"][p]
            p, q, _, _ = _passing(asked, p[early], sets, q[early], num, den)
            pair = np.unique(np.stack([asked["spot"][p], sets["spot"][q]]), axis=1)
            yield from rows(bucket, pair[0], pair[1], np.ones(pair.shape[1], np.int32), np.zeros(pair.shape[1], bool), ids, subs)

    def flush(bucket: int, blobs: list[bytes], probes: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not blobs:
            return
        t, ids, subs = _bucket(blobs, probes)
        if probes:
            yield from probe(bucket, t, ids, subs)
            return
        sets = _distinct_sets(t)
        kept = [np.unique(sets["key"][sets["splits"] > 1])]
        for y, x, apart, room, unseen in _walks(sets, num, den):
            order = np.lexsort((sets["spot"][x], apart, y))
            y, x, apart, room = y[order], x[order], apart[order], room[order]
            at = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if len(y) else np.zeros(0, int)
            size = np.diff(np.append(at, len(y)))
            rank = np.arange(len(y)) - np.repeat(at, size)
            near = [4 * apart[at] <= room[at], 2 * apart[at] <= room[at]]
            soon, most = np.select(near, [1, 4], PARTNERS), np.where(near[1], PARTNERS, 4 * PARTNERS)
            keep = rank < np.repeat(most, size)
            over = (size > most) | np.isin(y[at], unseen)
            turn, more = (rank >= np.repeat(soon, size))[keep].astype(np.int32), np.repeat(over, size)[keep]
            y, x = y[keep], x[keep]
            alone = np.setdiff1d(unseen, y)
            kept += [np.unique(sets["key"][y[more]]), np.unique(sets["key"][alone])]
            y, x = sets["spot"][y], sets["spot"][x]
            pair = np.lexsort((~more, turn, x, y))
            y, x, turn, more = y[pair], x[pair], turn[pair], more[pair]
            new = np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1]) | (more[1:] != more[:-1])]) if len(y) else np.zeros(0, bool)
            yield from rows(bucket, y[new], x[new], turn[new], more[new], ids, subs)
            yield from rows(bucket, sets["spot"][alone], None, np.full(len(alone), 2, np.int32), np.ones(len(alone), bool), ids, subs)
        full = np.flatnonzero(np.isin(t["key"], np.concatenate(kept).astype(np.uint32)))
        for lo in range(0, len(full), HELD):
            part = full[lo : lo + HELD]
            again = {c: t[c][part] for c, _ in _COLUMNS if c not in ("row", "place")}
            again |= {"row": (t["spot"][part] >> np.uint64(32)).astype(np.int64), "place": t["spot"][part] & np.uint64(0xFFFFFFFF)}
            none = [pa.nulls(1, k) for k in kinds * 2 + (pa.int32(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *none, pa.array([_packed(again, ids, subs)], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, probes = None, [], []
        for batch in batches:
            for bucket, blob, is_probe in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from flush(now, blobs, probes)
                    now, blobs, probes = bucket, [], []
                (probes if is_probe else blobs).append(blob)
        yield from flush(now, blobs, probes)

    return run


def _verify(num: int, den: int):
    """Of rows (id, sub, place, line, other line): the (id, sub, place)s whose lines do match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                a, b = (set(s.encode().split()) for s in (x, y))  # bytes split at ASCII white space alone
                both = len(a & b)
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:3]], SPOT)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines at the wanted places of each text."""
    for batch in batches:
        ids, subs, places, lines = [], [], [], []
        for key, sub, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            parts = text.split("\n")
            for k in wanted:
                ids.append(key)
                subs.append(sub)
                places.append(k)
                lines.append(parts[k])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(subs, pa.int64()), pa.array(places, pa.int32()), pa.array(lines, pa.string())], [*SPOT, "line"])


def _remove(at: int):
    """Texts in column ``at`` without the lines whose places the last column has, and how many these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(at), batch.column(batch.num_columns - 1)
            count = [len(g) if g is not None else 0 for g in gone.to_pylist()]
            hit = np.flatnonzero(count)
            cut = []
            for text, places in zip(texts.take(pa.array(hit)).to_pylist(), gone.take(pa.array(hit)).to_pylist(), strict=True):
                drop = set(places)
                cut.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop))
            if cut:
                which = np.arange(len(count))
                which[hit] = len(count) + np.arange(len(hit))
                texts = pa.concat_arrays([texts, pa.array(cut, texts.type)]).take(pa.array(which))
            columns = [*batch.columns[:-1], pa.array(count, pa.int64())]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_removed"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, columns by number, with ``_row_id`` and ``_row_sub``, which name a row and are its order.

    Rows with an id are named by it (ids that are no whole numbers by a hash) and their text. Rows without one come last,
    each by a number of its own, which is given once and stored.
    """
    whole = isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType))
    i, t = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    known = rows.where(i.isNotNull()).withColumns({"_row_id": i.cast("long") if whole else F.xxhash64(i), "_row_sub": F.xxhash64(t)})
    others = rows.where(i.isNull()).withColumns({"_row_id": F.lit(_NO_ID), "_row_sub": F.monotonically_increasing_id()})
    return known.unionByName(staged(others, "without_id"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, least: int = LEAST
) -> DataFrame:
    """Every row with its other columns, the lines that match an earlier one cut from the text, and ``n_removed``.

    Lines end at line feeds, words are runs without ASCII white space, and a line is judged if it has ``least`` distinct
    words. Lines match when ``den`` * intersection >= ``num`` * union of their word sets, for ``similarity``
    (num, den). Earlier is by (id, hash of the text, place in it), null ids last and in the order in which they are
    read, ids that aren't whole numbers in order of a hash; whether the earlier line is itself removed doesn't matter.
    Rows that repeat an id and its text are one document and lose the same lines; other rows of that id, and all rows
    without one, are judged on their own. A null text stays null; an ``n_removed`` of the input is replaced, other
    columns are kept whatever their names.
    """
    num, den = similarity
    spark = docs.sparkSession
    docs = docs.drop("n_removed")
    rows = _rows(docs, id_col, text_col)
    text_at = docs.columns.index(text_col)
    base = rows.where(f"c{text_at} is not null").select(F.col("_row_id").alias("id"), F.col(f"c{text_at}").alias("text"), F.col("_row_sub").alias("sub"))
    at = "id long, sub long, place int"
    survey = staged(base.mapInArrow(_survey(least), f"{at}, cls long, more long, n int, slice int, counts binary"), "lines")
    slices = survey.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(_add_slices, "slice int, counts binary")
    table = np.zeros(2 * SLOTS, np.uint8)
    for r in slices.collect():  # two rows of one-byte counters: the size is fixed
        table[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint8)
    held = spark.sparkContext.broadcast(table)

    occurs = survey.where("cls is not null").select("cls", "more", *SPOT)
    least_prefix = f"n - cast(ceil(n * {num}D / {den}) as long) + 1"
    n_postings = survey.agg(F.coalesce(F.sum(F.expr(least_prefix)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_postings // BUCKET))

    def searched(blobs: DataFrame) -> DataFrame:
        sorted_ = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").select("bucket", "blob", "probe")
        return sorted_.mapInArrow(_candidates(num, den), f"bucket int, {at}, xid long, xsub long, xplace int, turn int, more boolean, blob binary")

    def verified(found: DataFrame, all_lines: bool) -> DataFrame:
        """The lines (id, sub, place) that match their earlier partner."""
        pairs = staged(found.select(*SPOT, *OTHER).distinct(), "pairs")
        asked = pairs.select(*SPOT).union(pairs.select(*OTHER))
        # Stored, so that its size is known: Spark may send the few lines of the second look to all tasks.
        wanted = staged(asked.groupBy("id", "sub").agg(F.collect_set("place").alias("wanted")), "wanted")
        texts = base.join(wanted.hint("shuffle_hash") if all_lines else wanted, ["id", "sub"])
        lines = staged(texts.select("id", "sub", "text", "wanted").mapInArrow(_texts, f"{at}, line string").dropDuplicates(SPOT), "texts")
        full = pairs.join(lines.withColumnRenamed("line", "x"), SPOT)
        full = full.join(lines.select(*[F.col(c).alias(x) for c, x in zip(SPOT, OTHER, strict=True)], F.col("line").alias("y")), OTHER)
        out = staged(full.select(*SPOT, "x", "y").mapInArrow(_verify(num, den), at).distinct(), "later")
        release(spark, pairs, wanted, lines)
        return out

    postings = base.mapInArrow(_postings(held, least, num, den, buckets), "bucket int, blob binary")
    found = staged(searched(postings.withColumn("probe", F.lit(False))), "candidates")
    del postings
    release(spark)
    later = verified(found.where("turn = 0"), True)
    rest = staged(found.where("turn > 0 or more").select(*SPOT, *OTHER, "turn", "more").join(later, SPOT, "left_anti"), "rest")
    if not rest.isEmpty():  # lines with more candidates, of which the nearest don't match
        asking = rest.where("more").groupBy("id", "sub").agg(F.collect_set("place").alias("asked"))
        probes = base.join(asking, ["id", "sub"]).select("id", "text", "sub", "asked").dropDuplicates(["id", "sub"])
        probes = probes.mapInArrow(_postings(held, least, num, den, buckets, asked=True), "bucket int, blob binary")
        groups = found.where("blob is not null").select("bucket", "blob", F.lit(False).alias("probe"))
        others = rest.where("turn = 1").select(*SPOT, *OTHER).unionByName(
            searched(groups.unionByName(probes.withColumn("probe", F.lit(True)))).select(*SPOT, *OTHER)
        )
        later = staged(later.union(verified(others, False)).distinct(), "later")

    # A line goes unless it is the first of its set and matches no earlier one.
    groups = occurs.groupBy("cls", "more").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(*SPOT)).alias("first")).where("k > 1")
    copies = occurs.join(groups, ["cls", "more"]).where(F.struct(*SPOT) != F.col("first")).select(*SPOT)
    gone = copies.union(later).groupBy(F.col("id").alias("_row_id"), F.col("sub").alias("_row_sub")).agg(F.collect_set("place").alias("_gone"))
    gone = staged(gone, "gone")
    release(spark, survey, found, later, rest)
    full = rows.join(gone.hint("shuffle_hash"), ["_row_id", "_row_sub"], "left").select(*[f"c{k}" for k in range(len(docs.columns))], "_gone")
    schema = StructType([f for f in full.schema.fields if f.name != "_gone"]).add("n_removed", "long")
    return full.mapInArrow(_remove(text_at), schema).toDF(*docs.columns, "n_removed")
