"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Sources in order of code points get these weights, again and again.
WEIGHTS = (3, 1, 2)
#: The mix is to hold this share of all words, and no source more than this many times its own.
SHARE, MOST = 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``: weights by order, filled up to ``most`` times.

    What a capped source cannot take is shared again among the others by weight. With sources sorted by size over
    weight the caps bind for a prefix, and the level for the rest follows from prefix sums. One row per source
    is all that is gathered here.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(every) - 1) % len(weights) + 1)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    by_room = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    so_far, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        F.lit(share) * F.sum("source_size").over(whole)
        - F.lit(most) * F.coalesce(F.sum("source_size").over(so_far), F.lit(0))
    ) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(so_far), F.lit(0.0)))
    room = F.lit(float(most)) * F.col("source_size")
    # The first source that has room for the level, and all after it, get the level times their weight.
    found = by_source.withColumn("level", level).withColumn("room", room)
    found = found.withColumn("fits", F.col("level") * F.col("w") <= F.col("room"))
    first = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        by_room.rowsBetween(Window.unboundedPreceding, 0)
    )
    return found.withColumn("first", first).select(
        "source", "source_size", F.coalesce(F.col("first") * F.col("w"), F.col("room")).alias("target")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Within a source every document expects target / source_size copies. Documents stand in order of (size, hash of id and text,
    id); the running sum of expected copies plus one offset per source gives as many copies as whole numbers
    are crossed. In order of size the words taken differ from the target by about one long document at most. The
    offset and the order come from hashes, so reruns agree. A null text has size 0, a null source is a source and
    comes last; repeated rows are documents of their own, which columns to ``keep`` can tell apart. Empty input gives no rows.
    """
    # Rows of one id, or without one, are told apart by their texts.
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    sizes = staged(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.substring(F.md5(name.cast("binary")), 1, 2).alias("b"), *keep,
        ),
        "sizes",
    )
    # Ranks of a source from ranks in its cells (size, hash byte) and the number of rows in earlier cells: of earlier
    # ranges of sizes, earlier sizes in the range, and earlier bytes of the size.
    cell = Window.partitionBy("source", "size", "b").orderBy(F.col("id").asc_nulls_last(), *keep)
    cells = sizes.groupBy("source", F.shiftright("size", 8).alias("range"), "size", "b").agg(F.count(F.lit(1)).alias("n"))
    keys, cells = ["source", "range", "size", "b"], cells.withColumn("before", F.lit(0).cast("long"))
    for depth in (3, 2, 1):
        within, by = keys[:depth], keys[depth]
        so_far = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = cells.groupBy(*within, by).agg(F.sum("n").alias("k")).withColumn("k", F.coalesce(F.sum("k").over(so_far), F.lit(0)))
        sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in (*within, by)], "k")
        same = F.lit(True)
        for c in (*within, by):
            same = same & cells[c].eqNullSafe(F.col(f"s_{c}"))
        cells = cells.join(sums, same).select(*keys, "n", (F.col("before") + F.col("k")).alias("before"))
    ranked = sizes.withColumn("rn", F.row_number().over(cell))
    same = ranked["source"].eqNullSafe(cells["source"]) & (ranked["size"] == cells["size"]) & (ranked["b"] == cells["b"])
    placed = ranked.join(cells, same).select(
        ranked["id"], ranked["source"], ranked["size"], (F.col("before") + F.col("rn")).alias("rank"), *[ranked[c] for c in keep]
    )
    targets = source_targets(sizes, weights, share, most)
    unit = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    targets = targets.select(
        F.col("source").alias("s"), "source_size", "target", unit.alias("u"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    copies = F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor(
        (F.col("rank") - 1) * F.col("rate") + F.col("u")
    )
    return placed.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *keep,
    )
