"""A corpus pipeline: quality filter, line dedup, near-duplicate join, source mixing and packing, over all documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; what it returns is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parimart.llm import line_dedup, mixing, ngram_join, packing, quality
from parimart.llm.common import staged
from parimart.session import ship


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names under others that no column has, and the names to give them back."""
    spare = "_" * (1 + max(map(len, docs.columns)))
    moved = {c: c + spare for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(moved), {new: old for old, new in moved.items()}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be good; fitted on labelled ones that aren't held out.

    Without any labelled row nothing is rejected.
    """
    model = quality.train(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = _aside(docs, "score", "predicted")
    return quality.score_quality(own, model).where("predicted = 1").select(*own.columns).withColumnsRenamed(back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; ``n_chars`` follows. What has no word left is dropped,
    what had none before stays."""
    ship(spark)
    docs, back = _aside(docs, "n_removed")
    cut = line_dedup.drop_repeated_lines(docs, least=1)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return left.select(*docs.columns).withColumnsRenamed(back)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard similarity (0.8, five words) the one with the smallest id.

    Documents without words or without an id stay; rows that repeat an id stay together.
    """
    ship(spark)
    groups = ngram_join.jaccard_components(docs)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times; rows that repeat an id or have none count on their own."""
    ship(spark)
    # The rows' numbers are given once and stored.
    row = "_row" + "_" * max(map(len, docs.columns))
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = mixing.mix_sources(rows, keep=(row,)).where("copies > 0").select(row, F.col("copies").cast("int").alias(f"{row}n"))
    taken = rows.join(copies, row)
    return taken.withColumn(f"{row}c", F.explode(F.array_repeat(F.lit(0), F.col(f"{row}n")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, copies each, with their sequences and places."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: The stages learn, join by similarity and pack; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
