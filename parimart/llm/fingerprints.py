"""Document fingerprints: a homomorphic multiset hash of paragraphs (DataFrame functions only).

Every paragraph is hashed to a wide vector, a text's fingerprint is the sum of its paragraphs' vectors modulo powers
of two. The order of paragraphs doesn't matter, and one is inserted or deleted by adding or subtracting its vector.
The vector has two parts: ``WORDS`` numbers of 32 bits that tell multisets apart, and counters of hash bits, three to
a long, whose inner product estimates how many paragraphs two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WORDS, LANES, HASHES = 8, 21, 4
_ONES = 1 | 1 << LANES | 1 << 2 * LANES
_MOD = 2**62 - 1
#: Documents of a run that are put in order together; only the first one of each run also goes to the run before.
RUN = 512
_FIRST = 2**33
_SEEDS = (0, 1, *range(WORDS // 2 + 2, WORDS // 2 + HASHES))


def paragraphs(text: Column) -> Column:
    """Sentences with their end marks, without white space around them.

    One of more than 396 characters is cut at its clause marks from the left as long as that much is left, and after 396
    characters where it has no such mark: an insertion changes the pieces up to it, never those behind.
    """
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?\n]{0,396}+[.!?]{1,4}|[^.!?\n]{0,395}?[,;:|] |[^.!?\n]{1,396}"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def paragraph_vector(p: Column) -> Column:
    low = F.lit(2**32 - 1)
    words = []
    for i in range(WORDS // 2):
        h = F.xxhash64(p, F.lit(i + 2))
        words += [h.bitwiseAND(low), F.shiftrightunsigned(h, 32)]
    bits = [F.shiftright(F.xxhash64(p, F.lit(k)), j).bitwiseAND(F.lit(_ONES)) for k in _SEEDS for j in range(LANES)]
    return F.array(*words, *bits, F.lit(1).cast("long"))


def add(a: Column, b: Column) -> Column:
    """Sum of two vectors: texts put together, or a paragraph inserted."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MOD)))


def subtract(a: Column, b: Column) -> Column:
    """``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_MOD)))


def fingerprint(text: Column) -> Column:
    zero = F.array_repeat(F.lit(0).cast("long"), WORDS + HASHES * LANES + 1)
    return F.aggregate(paragraphs(text), zero, lambda acc, p: add(acc, paragraph_vector(p)))


def to_text(vector: Column) -> Column:
    """Hexadecimal digits, the counters by lane; two fingerprints are equal if their texts are."""
    words = F.transform(F.slice(vector, 1, WORDS), lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(2**32 - 1)))), 8, "0"))
    rest = F.transform(F.slice(vector, WORDS + 1, HASHES * LANES + 1), lambda x: F.lower(F.hex(x)))
    return F.concat(F.array_join(words, ""), F.lit("-"), F.array_join(rest, "-"))


def _signed_product(shift: int, n: Column, m: Column):
    def counter(x: Column) -> Column:
        return F.shiftright(x, shift).bitwiseAND(F.lit(2**LANES - 1)) * 2

    return lambda x, y: (counter(x) - n).cast("double") * (counter(y) - m).cast("double")


def _dot(a: Column, b: Column) -> Column:
    """Inner product of the multisets, estimated from 252 signed counters (ones less zeros)."""
    n, m = F.element_at(a, -1), F.element_at(b, -1)
    signed = []
    for lane in range(3):
        signed.append(
            F.zip_with(F.slice(a, WORDS + 1, HASHES * LANES), F.slice(b, WORDS + 1, HASHES * LANES), _signed_product(lane * LANES, n, m))
        )
    total = F.aggregate(F.concat(*signed), F.lit(0.0), lambda s, x: s + x)
    return total / (3 * HASHES * LANES)


def likeness(a: Column, b: Column) -> Column:
    """Shared paragraphs to all, 0 to 1 (Dice); 1 for equal vectors, two empty ones too."""
    both = _dot(a, a) + _dot(b, b)
    dice = F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * _dot(a, b) / both))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.coalesce(dice, F.lit(0.0)))


def successors(runs: DataFrame) -> DataFrame:
    """``(part, run, next_part, next_run)`` of runs numbered within parts: the one behind, after the last the first.

    Within a part runs follow each other; one row a part, as many as tasks, is all that one task puts in order.
    """
    near = runs.withColumn("near", F.lead("run").over(Window.partitionBy("part").orderBy("run")))
    parts = runs.groupBy("part").agg(F.min("run").alias("first"))
    every = Window.orderBy("part")
    parts = parts.select(
        "part", F.coalesce(F.lead("part").over(every), F.min("part").over(Window.partitionBy())).alias("np"),
        F.coalesce(F.lead("first").over(every), F.first("first").over(every)).alias("nr"),
    )
    return near.join(parts, "part").select(
        "part", "run", F.when(F.col("near").isNull(), F.col("np")).otherwise(F.col("part")).alias("next_part"),
        F.coalesce("near", "nr").alias("next_run"),
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document.

    Next is by descending id of any type (repeated ids: by a hash of the text; null ids last), and the first after the
    last. Columns: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    A null text counts as empty; repeated rows follow each other; an empty table gives no rows. Rows are sorted by ranges
    that Spark samples, so sparse, repeated or null ids make no large task, and stored once with their fingerprints.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.desc_nulls_last("id"), F.col("hash"), F.col("row")]
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    seen = base.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text", F.monotonically_increasing_id().alias("at"))
    seen = staged(seen.withColumn("vec", fingerprint(F.col("text"))), "sorted")
    seen = seen.withColumns({"part": F.floor(F.col("at") / _FIRST), "run": F.floor(F.pmod(F.col("at"), F.lit(_FIRST)) / RUN)})
    w = Window.partitionBy("part", "run").orderBy("at")
    links = successors(seen.select("part", "run").distinct())
    heads = (
        seen.where(f"at % {_FIRST} % {RUN} = 0").select(F.col("part").alias("next_part"), F.col("run").alias("next_run"), "text", "vec")
        .join(links, ["next_part", "next_run"])
        .select("part", "run", F.col("text").alias("head_text"), F.col("vec").alias("head_vec"))
    )
    follow = seen.withColumn("next_text", F.lead("text").over(w)).withColumn("next_vec", F.lead("vec").over(w))
    last = F.col("s.next_text").isNull()
    same = (F.col("s.part") == F.col("h.part")) & (F.col("s.run") == F.col("h.run"))
    joined = follow.alias("s").join(heads.alias("h"), same & last, "left").select(
        "id", "text", "vec", F.coalesce("next_text", "head_text").alias("nt"), F.coalesce("next_vec", "head_vec").alias("nv")
    )
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("nt"), half))
    return (
        joined.withColumn("edited", edited)
        .select(
            "id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "vec", "nv", fingerprint(F.col("edited")).alias("evec"),
        )
        .select(
            F.col("id").alias(id_col), "n_chars", "edited_sha256", to_text(F.col("vec")).alias("fingerprint"),
            to_text(F.col("evec")).alias("edited_fingerprint"), likeness(F.col("vec"), F.col("evec")).alias("near_edited"),
            likeness(F.col("vec"), F.col("nv")).alias("near_next"),
        )
    )
