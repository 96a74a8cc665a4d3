"""Suffix-array deduplication: every byte that a repeated string of 200 bytes covers is removed.

The corpus has no single suffix array. Each string of ``LENGTH`` bytes belongs to one anchor, the least hashed
run of ``GRAM`` bytes in it (leftmost of equals), which equal strings share. Anchors are grouped by hash: strings
of an anchor that occurs once can't repeat, an anchor whose surroundings are wholly equal elsewhere repeats as it is,
and only the surroundings that differ somewhere, which lie where repeated passages begin or end, are put into suffix
arrays, all of an anchor together. Tasks put together what they find repeated themselves before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged
from .words import blocks, mix, utf8

LENGTH, GRAM = 200, 64
_WINDOW = LENGTH - GRAM + 1
#: Byte between the texts of a suffix array; UTF-8 has none such.
_END = 255
#: Bytes of a suffix array. An anchor with more different surroundings than ``HOT`` is divided by further anchors in
#: these, up to ``FINER`` times; what none of them divides differs by single bytes, and is compared by hashed strings.
ARRAY_BYTES, HOT, FINER = 512 * 1024, 4000, 4
_random = np.random.Generator(np.random.PCG64(8))
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_FACTOR = _random.integers(0, 2**64, 6, np.uint64) | np.uint64(1)


def anchors(data: np.ndarray, offsets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, ...]:
    """``(text, first, last, hash)`` of every anchor: starts first..last (in the block) of strings that it stands for."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h, step = _BYTE[data], 1
    for factor in _FACTOR:  # 2, 4 ... 64 bytes
        h = h[:-step] * factor + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h = mix(h ^ np.uint64(salt))
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= _WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (_WINDOW - step)], low[_WINDOW - step :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    start = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room) + np.repeat(offsets[:-1], room)
    of = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1 if len(begin) else begin
    return text[begin], start[begin], start[end], h[of[begin]]


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly. Then buckets are scanned in order: each suffix
    found puts its predecessor, if that is not smaller than its successor, next in the predecessor's own bucket.
    """
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    nxt = np.searchsorted(change, np.arange(n))
    small = np.zeros(n, bool)
    inner = nxt < len(change)
    c = change[nxt[inner]]
    small[inner] = text[c] < text[c + 1]
    raw = text.tobytes()
    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    size = np.bincount(text, minlength=256)
    start = np.cumsum(size) - size
    split = start + size - np.bincount(text[direct], minlength=256)
    out = np.zeros(n, np.int64)
    head = start.copy()
    for b in range(256):
        if not size[b]:
            continue
        of = direct[text[direct] == b] if len(direct) else direct
        out[split[b] : split[b] + len(of)] = of

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            count = np.bincount(first, minlength=256)
            rank = np.arange(len(first)) - np.repeat((np.cumsum(count) - count)[count > 0], count[count > 0])
            out[head[first] + rank] = before
            head[:] += count

    out[head[text[-1]]] = n - 1  # the successor of the last suffix is empty
    head[text[-1]] += 1
    for b in range(256):
        done = start[b]
        while done < head[b]:
            done, found = head[b], out[done : head[b]]
            induce(found)
        induce(out[split[b] : start[b] + size[b]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Of each suffix in ``order`` and the one before it, up to ``most`` bytes; both must have that many."""
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(most):
        live = live[text[order[live] + d] == text[order[live - 1] + d]]
        if not len(live):
            break
        lcp[live] = d + 1
    return lcp


def repeated_starts(parts: list[bytes]) -> list[np.ndarray]:
    """For each text whether the ``LENGTH`` bytes from each of its places start elsewhere among ``parts`` too."""
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size + 1) - size - 1
    whole = np.zeros(len(text), bool)
    for b, s in zip(begin, size, strict=True):
        whole[b : b + s - LENGTH + 1] = True
    order = suffix_array(text)
    order = order[whole[order]]
    same = common_prefixes(text, order) >= LENGTH
    twice = np.zeros(len(text), bool)
    twice[order[same]] = True
    twice[order[np.flatnonzero(same) - 1]] = True
    return [twice[b : b + s - LENGTH + 1] for b, s in zip(begin, size, strict=True)]


def _ranges(flags: np.ndarray, base: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(base + int(a), base + int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _twins(anchor: np.ndarray, around: np.ndarray) -> np.ndarray:
    """0 for occurrences without an equal one among these, 1 for the first of equal ones, 2 for the others."""
    order = np.lexsort((around, anchor))
    a, c = anchor[order], around[order]
    same = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
    kind = np.zeros(len(order), np.int8)
    kind[order[1:][same]] = 2
    lead = np.concatenate([same, [False]]) & ~np.concatenate([[False], same])
    kind[order[lead]] = 1
    return kind


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of anchors. Of equal ones in a batch the first alone goes to its anchor's task, the others are dealt evenly."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        uid = batch.column(0).to_numpy()
        found = []
        for lo, hi in blocks(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            text, first, last, h = anchors(part, at)
            view = memoryview(np.ascontiguousarray(part))
            around = [xxhash.xxh3_64_intdigest(view[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            found.append((h.view(np.int64), np.array(around, np.uint64).view(np.int64), uid[lo + text], first - at[text], last - at[text]))
        if found:
            anchor, around, row, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
            twin = _twins(anchor, around)
            deal = np.where(twin == 2, mix(np.arange(len(twin), dtype=np.uint64)).view(np.int64), anchor)
            columns = [deal, anchor, around, row, first.astype(np.int32), last.astype(np.int32), twin.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["deal", "anchor", "around", "uid", "first", "last", "twin"])


def _neighbours(keep: tuple[str, ...] = ("anchor", "uid", "first", "last")):
    """From rows in order of (anchor, around): kind 0 repeats as it is, 1 is to be compared, 2 stands for such as 0.

    A row is judged by the rows before and after it and by whether it has a twin already, so a group of any size streams
    through. The last column has ``twin``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, (None, None)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            twin = t["twin"].to_numpy()
            if (twin == 2).any():
                yield from _of_kind(t, 0, np.flatnonzero(twin == 2), keep)
                t = t.filter(pa.array(twin != 2))
            if t.num_rows:
                t = t if held is None else pa.concat_tables([held, t])
                n = t.num_rows - 1
                yield from _kinds(t, n, before, keep)
                if n:
                    before = (t["anchor"][n - 1].as_py(), t["around"][n - 1].as_py())
                held = t.slice(n)
        if held is not None:
            yield from _kinds(held, 1, before, keep)

    return run


def _of_kind(t: pa.Table, kind: int, picked: np.ndarray, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if len(picked):
        part = t.select(list(keep)).take(pa.array(picked)).combine_chunks()
        yield part.append_column("kind", pa.array(np.full(len(picked), kind, np.int32))).to_batches()[0]


def _kinds(t: pa.Table, n: int, before: tuple, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    anchor, around, twin = t["anchor"].to_numpy(), t["around"].to_numpy(), t["twin"].to_numpy()[:n] == 1
    one = anchor[1:] == anchor[:-1]
    two = one & (around[1:] == around[:-1])
    prior = before[0] is not None and before[0] == anchor[0]
    a_prev, a_next = np.concatenate([[prior], one]), np.concatenate([one, [False]])
    c_prev, c_next = np.concatenate([[prior and before[1] == around[0]], two]), np.concatenate([two, [False]])
    again, many = (c_prev | c_next)[:n] | twin, (a_prev | a_next)[:n]
    for kind, rows in ((0, again), (1, many & ~again), (2, again & many & ~c_prev[:n])):
        yield from _of_kind(t, kind, np.flatnonzero(rows), keep)


def _divide(salt: int):
    """Surroundings cut up by further anchors in them; equal strings share these too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(4).to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            data = np.frombuffer(b"".join(parts), np.uint8)
            text, first, last, h = anchors(data, offsets, salt)
            old, uid, base, kind = (batch.column(i).to_numpy()[text] for i in range(4))
            anchor = mix(old.view(np.uint64) + h).view(np.int64)
            raw = memoryview(data)
            cut = [bytes(raw[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            around = np.array([xxhash.xxh3_64_intdigest(x) for x in cut], np.uint64).view(np.int64)
            first = first - offsets[text]
            # What stands for repeated ones already needs no mark of its own.
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(around), pa.array(uid), pa.array((base + first).astype(np.int32)), pa.array((base + last - offsets[text]).astype(np.int32)),
                 pa.array(cut, pa.binary()), pa.array(kind), pa.array(np.zeros(len(text), np.int32))],
                ["anchor", "around", "uid", "first", "last", "part", "was", "twin"],
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole anchors, rows in order of anchor; the ranges of starts that repeat."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        found = repeated_starts([r[4] for r in held])
        out = [(r[1], a, b) for r, flags in zip(held, found, strict=True) if r[3] == 1 for a, b in _ranges(flags, r[2])]
        if out:
            u, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["uid", "first", "last"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and size >= ARRAY_BYTES and row[0] != held[-1][0]:
                yield from flush()
                held, size = [], 0
            held.append(row)
            size += len(row[4]) + 1
    if held:
        yield from flush()


def _hash_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, uid, first, _, part in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            rows += [(*divmod(xxhash.xxh3_128_intdigest(part[i : i + LENGTH]), 2**64), uid, first + i) for i in range(len(part) - LENGTH + 1)]
        if rows:
            a, b, uid, first = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(uid, pa.int64()),
                 pa.array(first, pa.int32()), pa.array(first, pa.int32()), pa.array(np.zeros(len(first), np.int32))],
                ["anchor", "around", "uid", "first", "last", "twin"],
            )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, uid, wanted in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = memoryview(text.as_buffer())
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([uid] * len(wanted), pa.int64()),
                 pa.array([w["first"] for w in wanted], pa.int32()), pa.array([w["kind"] for w in wanted], pa.int32()),
                 pa.array([bytes(raw[w["first"] : w["last"] + LENGTH]) for w in wanted], pa.binary())],
                ["anchor", "uid", "first", "kind", "part"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)
            step = np.zeros(len(raw) + 1, np.int64)
            for s in spans or ():
                step[s["first"]] += 1
                step[s["last"] + LENGTH] -= 1
            gone = np.cumsum(step)[:-1] > 0
            kept = raw[~gone].tobytes()
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        c = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, k) for x, k in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (bytes).

    A null text is empty. Texts of equal rows and of different rows are all judged on the input; a repeated row
    repeats its strings. Matches never cross texts. Empty input gives no rows. Rows are numbered once and stored, so
    neither ids nor texts have to tell them apart.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = staged(raw.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    found = raw.select("uid", "text").mapInArrow(
        _find_anchors, "deal long, anchor long, around long, uid long, first int, last int, twin int"
    )
    marks = "anchor long, uid long, first int, last int, kind int"
    near = found.repartition("deal").sortWithinPartitions("deal", "around").select("anchor", "around", "uid", "first", "last", "twin")
    near = staged(near.mapInArrow(_neighbours(), marks), "anchors")
    release(spark)

    open_ = near.where("kind = 1").select("anchor").distinct()
    todo = near.where("kind > 0").join(open_, "anchor", "left_semi")
    wanted = todo.groupBy("uid").agg(F.collect_list(F.struct("anchor", "first", "last", "kind")).alias("w"))
    pieces = "anchor long, uid long, first int, kind int, part binary"
    parts = raw.join(wanted, "uid").select(F.col("text").cast("binary").alias("text"), "uid", "w").mapInArrow(_slices, pieces)
    parts = staged(parts, "surroundings")
    release(spark)

    compared = []
    spans = near.where("kind = 0").select("uid", "first", "last")
    for salt in range(1, FINER + 1):
        hot = staged(parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
        if hot.isEmpty():
            break
        compared.append(parts.join(hot, "anchor", "left_anti"))
        finer = parts.join(hot, "anchor", "left_semi").select("anchor", "uid", "first", "kind", "part").mapInArrow(
            _divide(salt), "anchor long, around long, uid long, first int, last int, part binary, was int, twin int"
        )
        finer = finer.repartition("anchor", "around").sortWithinPartitions("anchor", "around")
        finer = staged(finer.mapInArrow(_neighbours(("anchor", "uid", "first", "last", "part", "was")), "anchor long, uid long, first int, last int, part binary, was int, kind int"), "finer")
        spans = spans.unionByName(finer.where("kind = 0 and was = 1").select("uid", "first", "last"))
        parts = finer.where("kind > 0").select("anchor", "uid", "first", F.when(F.col("kind") == 2, 2).otherwise(F.col("was")).alias("kind"), "part")
    else:
        hot = staged(parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
        hashed = (
            parts.join(hot, "anchor", "left_semi").select("anchor", "uid", "first", "kind", "part")
            .mapInArrow(_hash_starts, "anchor long, around long, uid long, first int, last int, twin int")
            .repartition("anchor", "around").sortWithinPartitions("anchor", "around").mapInArrow(_neighbours(), marks)
            .where("kind = 0").select("uid", "first", "last")
        )
        spans = spans.unionByName(hashed)
        parts = parts.join(hot, "anchor", "left_anti")
    for frame in compared:
        parts = parts.unionByName(frame)
    sorted_ = (
        parts.repartition("anchor").sortWithinPartitions("anchor", "uid", "first")
        .select("anchor", "uid", "first", "kind", "part").mapInArrow(_compare, "uid long, first int, last int")
    )
    spans = spans.unionByName(sorted_).groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        raw.join(spans, "uid", "left").select("id", F.col("text").cast("binary").alias("text"), "spans")
        .mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        .withColumnRenamed("id", id_col)
    )
