"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own characters say so, so equal texts have equal chunks. The text itself is shuffled
once, chunk by chunk with map-side combining, to verify that every 64-bit chunk identifier stands for one text;
from then on documents are compared by their recipes, the ordered lists of identifiers (about 1 % of the text).
Identifiers that two chunk texts share get a rank, so recipes are equal exactly when texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks: a chunk ends after a line or clause end, ``least`` characters at the earliest.

    Without such an end within ``most`` characters the chunk is cut there. Joined they are the text.
    """
    pattern = rf"(?s).{{{least},{most}}}?(?:\n|[.,] )|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays. A null text counts as empty; the empty text is a text like
    any other. Rows that repeat an id with the same text count in ``group_size`` and share the verdict. A null id
    never stays unless all ids of its group are null. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    cut = base.select("id", chunks(F.col("text")).alias("c"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))

    store = cut.select(F.explode("c").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk").distinct()
    clash = staged(store.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "clash")

    ids = F.transform("c", lambda x: F.xxhash64(x)).alias("recipe")
    recipes = cut.select("id", ids, "sha")
    if clash.isEmpty():
        recipes = recipes.withColumn("ranks", F.array().cast("array<struct<p:int,r:int>>"))
    else:
        ranked = store.join(clash, "h", "left_semi").withColumn(
            "r", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
        )
        marks = (
            cut.select("sha", F.posexplode("c").alias("p", "chunk"))
            .withColumn("h", F.xxhash64("chunk"))
            .join(ranked, ["h", "chunk"])
            .select("sha", "p", "r")
            .distinct()
            .groupBy("sha")
            .agg(F.array_sort(F.collect_list(F.struct("p", "r"))).alias("ranks"))
        )
        recipes = recipes.join(marks, "sha", "left").withColumn(
            "ranks", F.coalesce("ranks", F.array().cast("array<struct<p:int,r:int>>"))
        )
    recipes = staged(recipes, "recipes")

    key = ["recipe", "ranks"]
    # Staged, so that both sides of the join are plain shuffles and a hot group can be split by AQE.
    groups = staged(
        recipes.groupBy(*key).agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups"
    )
    return recipes.join(groups, key, "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("n").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
