"""N-gram Jaccard join: a count-vector R-tree over shingle sets, its candidates verified exactly.

Shingles are hashed into 2^L groups, L by the size of the set. A set's group counts are its point: two sets share at
most the sum of the coordinates' minima. As many groups as sets of that size may differ in, and one more, leave two
linked sets at least one group with the very same shingles, so points meet in blocks keyed by a group's content, and a
block is searched with an R-tree. A first round bounds and verifies each block's sets against its most met one; blocks whose
sets are then in one component are done, the others are searched for pairs between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged
from .words import Words, blocks, mix, utf8

#: Points of a block that a task searches against as many others; larger blocks are cut up.
CHUNK = 2000
LEAF, FANOUT = 32, 8
#: Points have 2 ** FINER groups for each that blocks are keyed by.
FINER = 2
#: The last level; its groups hold one shingle each.
FINEST = 40


def differ(size: int, num: int, den: int) -> int:
    """The most shingles that two linked sets, of which the smaller has ``size``, can differ in."""
    return (den - num) * size // num


def levels(size: int, num: int, den: int) -> set[int]:
    """Levels at which a set must be indexed: that of the smaller set of any linked pair it is in."""
    return {differ(s, num, den).bit_length() for s in (-(-num * size // den), size)} - {0}


def point(shingles: np.ndarray, level: int) -> bytes:
    """Counts of a set's groups, four to each group of its blocks, so about one shingle each; a byte holds 254 at most."""
    if not level:
        return b""
    group = (shingles >> np.uint64(64 - level - FINER)).astype(np.int64)
    return np.minimum(np.bincount(group, minlength=1 << (level + FINER)), 255).astype(np.uint8).tobytes()


def coordinates(data: bytes, width: int) -> np.ndarray:
    """A point's counts, folded to ``width`` groups; 255 stands for any larger count and bounds nothing."""
    raw = np.frombuffer(data, np.uint8).astype(np.int32)
    raw[raw == 255] = 1 << 20
    return raw.reshape(width, -1).sum(axis=1, dtype=np.int32)


def group_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set's blocks: level, group and content of every group that isn't empty.

    Two linked sets that have no filled group in common differ in each of them, so neither fills more than they may differ
    in; such sets get keys of the next level too, until they fill more. So every key has content.
    """
    out, done = [np.zeros(0, np.uint64)], set()
    most = differ(len(shingles), num, den)
    for level in sorted(levels(len(shingles), num, den)):
        while level not in done:
            done.add(level)
            group = (shingles >> np.uint64(64 - level)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            content = np.add.reduceat(mix(shingles ^ np.uint64(level)), at)
            out.append(mix(content + mix(np.uint64(level << 40) + group[at].astype(np.uint64))))
            if len(at) <= most and level < FINEST:
                # At a similarity of a half or less any one common shingle may be all.
                level = level + 1 if 2 * num > den else FINEST
    return np.concatenate(out)


def overlap_bound(a: bytes, b: bytes) -> int:
    """The most shingles that two sets with these points can share; the finer one is folded to the coarser."""
    n = min(len(a), len(b))
    return int(np.minimum(coordinates(a, n), coordinates(b, n)).sum())


def _may_link(bound, a, b, num: int, den: int):
    """Whether sets of sizes a and b that share ``bound`` at most can reach the similarity."""
    return (num + den) * bound >= num * (a + b)


class RTree:
    """Points packed by size and leading counts; nodes keep the largest counts and the smallest size below them."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, labels: np.ndarray):
        slab = np.argsort(np.argsort(sizes, kind="stable")) // (LEAF * FANOUT)
        self.order = np.lexsort((points[:, -1], points[:, 0], slab))
        self.sizes, self.points, self.labels = sizes[self.order], points[self.order], labels[self.order]
        self.tiers, step, n = [], LEAF, len(sizes)
        high, small, lo, hi = self.points, self.sizes, self.labels, self.labels
        width = LEAF
        while True:
            at = np.arange(0, len(high), width)
            high, small = np.maximum.reduceat(high, at), np.minimum.reduceat(small, at)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.tiers.append((step, high, small, lo, hi))
            if len(at) <= FANOUT or step >= n:
                break
            width, step = FANOUT, step * FANOUT

    def search(self, size: int, point: np.ndarray, label: int, num: int, den: int) -> np.ndarray:
        """Places (in the input) of points of other labels whose bound reaches the similarity."""
        live = np.arange(len(self.tiers[-1][1]))
        for t in range(len(self.tiers) - 1, -1, -1):
            step, high, small, lo, hi = self.tiers[t]
            ok = _may_link(np.minimum(high[live], point).sum(axis=1), small[live], size, num, den)
            live = live[ok & ~((lo[live] == label) & (hi[live] == label))]
            below = step // (self.tiers[t - 1][0] if t else 1)
            top = len(self.tiers[t - 1][1]) if t else len(self.sizes)
            live = (live[:, None] * below + np.arange(below)).ravel()
            live = live[live < top]
        ok = _may_link(np.minimum(self.points[live], point).sum(axis=1), self.sizes[live], size, num, den)
        ok &= (self.labels[live] != label) & (num * np.maximum(self.sizes[live], size) <= den * np.minimum(self.sizes[live], size))
        return self.order[live[ok]]


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets):
        yield from Words(data, offsets[lo : hi + 1], lower=True).sets(k)


def _name(shingles: np.ndarray) -> int:
    """64-bit hash of a whole set; with the 64-bit shingles it is taken as the set's identity."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def _index(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), k))
            level = [differ(len(s), num, den).bit_length() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([point(s, n) for s, n in zip(sets, level, strict=True)], pa.binary()), batch.column(2)],
                ["id", "cls", "n", "point", "text_hash"],
            )

    return run


def _keys(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends a set once, however many copies it meets
        for batch in batches:
            for s in _sets(batch.column(0), k):
                name = _name(s)
                if len(s) and name not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(name)
                    keys = group_keys(s, num, den)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), name, np.int64))], ["key", "cls"]
                        )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return joined


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (key, cls): those whose key has two sets, each once."""
    last_key = last_cls = None
    alone = True
    for batch in batches:
        key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        fresh[0] = (key[0], cls[0]) != (last_key, last_cls)
        key, cls = key[fresh], cls[fresh]
        if not len(key):
            continue
        goes_on = last_key is not None and key[0] == last_key
        if goes_on and alone:  # the row held back has company
            key, cls = np.concatenate([[last_key], key]), np.concatenate([[last_cls], cls])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(at, len(key)))
        many = np.repeat(size > 1, size)
        if goes_on and not alone:
            many[: size[0]] = True
        last_key, last_cls, alone = int(key[-1]), int(cls[-1]), not many[-1]
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(cls[many])], ["key", "cls"])


def _bound(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, p, q in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                fits = num * max(n, m) <= den * min(n, m)
                keep.append(fits and bool(_may_link(overlap_bound(p, q), n, m, num, den)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def _search(num: int, den: int):
    """Rows in order of block and chunks: the pairs of different components that may link, block by block."""

    def block(rows: list[tuple]) -> list[tuple[int, int]]:
        _, i, j, names, labels, sizes, side, points = zip(*rows, strict=True)
        width = min(map(len, points))
        matrix = np.stack([coordinates(p, width) for p in points])
        names, sizes, side = np.array(names), np.array(sizes), np.array(side)
        _, labels = np.unique(np.array(labels), return_inverse=True)
        stored = np.flatnonzero(side == i[0])
        asked = stored if i[0] == j[0] else np.flatnonzero(side == j[0])
        found: list[tuple[int, int]] = []
        if len(stored) and len(asked):
            tree = RTree(sizes[stored], matrix[stored], labels[stored])
            for x in asked:
                y = stored[tree.search(sizes[x], matrix[x], labels[x], num, den)]
                if i[0] == j[0]:
                    y = y[y < x]
                found += [(max(names[x], n), min(names[x], n)) for n in names[y]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: set[tuple[int, int]] = set()

        def sent() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    found.update(block(held))
                    held = []
                held.append(row)
            if len(found) > 50_000:
                yield sent()
        if held:
            found.update(block(held))
        yield sent()

    return run


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            sets = (_sets(batch.column(c), k) for c in (2, 3))
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *sets, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: tuple[int, int] = (4, 5)
) -> DataFrame:
    """One row per row: id, ``n_shingles`` (distinct ``k``-word shingles) and ``component_id``.

    Texts link when ``den`` * intersection >= ``num`` * union for ``similarity`` (num, den); the component is the
    smallest id that links reach. Words are lower-cased (A-Z) runs without ASCII white space; with fewer than
    ``k`` words the whole sequence is the only shingle. Null, empty and blank texts have none, link with nothing and
    are their own component. Texts with equal sets are one point, so copies cost nothing; their rows all appear. Rows
    without an id don't name a component, but link others; a repeated id joins its texts' components.
    """
    num, den = similarity
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kind = base.schema["id"].dataType.simpleString()
    index = staged(base.mapInArrow(_index(k, num, den), f"id {kind}, cls long, n long, point binary, text_hash long"), "index")
    # One text of each set stands for it: of an id, or of rows without one, with the hash of that text.
    points = index.where("n > 0").groupBy("cls").agg(
        F.min(F.struct("id", "text_hash")).alias("of"), F.first("n").alias("n"), F.first("point").alias("point")
    ).select("cls", "of.*", "n", "point")
    points = staged(points, "points")

    keys = base.select("text").mapInArrow(_keys(k, num, den), "key long, cls long")
    met = keys.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_blocks, "key long, cls long")
    met = staged(met, "blocks")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets that do link: texts of those in question are read again and compared."""
        pairs = staged(pairs, "pairs")
        asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        of = points.join(asked, "cls").select("cls", F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"))
        texts = base.where("text is not null").join(of, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
        named = texts.select("cls", "text").mapInArrow(_named(k), "cls long, text string").dropDuplicates(["cls"])
        named = staged(named, "texts")
        full = pairs.join(named.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a")
        full = full.join(named.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(_verify(k, num, den), "a long, b long")

    def measured(pairs: DataFrame) -> DataFrame:
        for side, n, p in (("a", "n", "p"), ("b", "m", "q")):
            pairs = pairs.join(points.select(F.col("cls").alias(side), F.col("n").alias(n), F.col("point").alias(p)), side)
        return pairs.select("a", "b", "n", "m", "p", "q").mapInArrow(_bound(num, den), "a long, b long")

    # The set that meets others in most blocks stands in the middle of its block: edited copies are nearer to
    # what they were copied from than to each other.
    degree = met.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    heads = met.join(degree, "cls").groupBy("key").agg(F.max_by("cls", F.struct("n", "cls")).alias("head"))
    star = met.join(staged(heads, "heads"), "key").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct()
    links = staged(verified(measured(star)), "links")
    labels = staged(connected_components(links), "labels")

    # Blocks that hold sets of more than one component so far.
    told = met.join(labels, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("label"))
    open_ = (
        told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
        .where("lo <> hi").select("key", F.ceil(F.col("size") / CHUNK).cast("int").alias("parts"))
    )
    rows = told.join(open_, "key").withColumn("side", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = rows.join(points.select("cls", "n", "point"), "cls")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "key", "cls", "label", "n", "point", "side", F.least("side", "other").alias("ci"), F.greatest("side", "other").alias("cj")
    )
    rows = rows.select("key", "ci", "cj", "cls", "label", "n", "side", "point").repartition("key", "ci", "cj")
    crossed = rows.sortWithinPartitions("key", "ci", "cj").mapInArrow(_search(num, den), "a long, b long").distinct()
    links = links.unionByName(verified(crossed))
    labels = staged(connected_components(links), "labels")

    placed = index.join(labels, F.col("cls") == F.col("node"), "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("label")
    )
    placed = staged(placed, "placed")
    least = staged(placed.where("label is not null").groupBy("label").agg(F.min("id").alias("least")), "least")
    return placed.join(least, "label", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")
    )


def _named(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pa.array([_name(s) for s in _sets(batch.column(1), k)], pa.int64())
            keep = pa.array(np.asarray(same) == batch.column(0).to_numpy())
            yield batch.filter(keep)

    return run
