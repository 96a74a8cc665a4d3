"""Chat formatting by multi-party perspective rotation (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns of one output row; longer conversations go on in further segments.
SEGMENT = 512


def _head(role: Column, speaker: Column) -> Column:
    name = role
    for c in "%|<>\n":  # distinct roles keep distinct names
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """A row for every conversation, participant and segment: the dialogue with that participant as assistant.

    Others are named users. ``mask`` lists ``start:end`` (code points, end exclusive) of what the assistant says,
    end marks included; ``rendered`` is the text, ``n_turns`` and ``n_masked`` count turns. A turn's segment
    is turn // ``segment`` (0 for null), so no row grows with the length of a conversation and none is cut off.
    Turns stand in order of (turn, role, text), nulls first. A null role is the participant "unknown", a null text
    is empty, rows of null conv_id are one conversation; repeated rows are repeated turns. ``%|<>`` and line feeds of a name
    are escaped, and ``<|`` in a text becomes ``< |``: no speaker can write a mark or another one's turn.
    """
    t = turns.select(
        F.col(conv_col).alias("conv"),
        F.coalesce(F.floor(F.col(turn_col) / F.lit(segment)), F.lit(0)).cast("long").alias("seg"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
            F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        ).alias("m"),
    )
    who = t.select(F.col("conv").alias("c"), F.col("m.role").alias("speaker")).distinct()
    parts = t.groupBy("conv", "seg").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    # Messages move once, before the rotation; a participant list row is a few bytes.
    both = parts.join(who, parts["conv"].eqNullSafe(who["c"]))
    end = F.lit("<|end|>\n")
    heads = F.transform("ms", lambda m: _head(m["role"], F.col("speaker")))
    bodies = F.transform("ms", lambda m: F.concat(m["text"], end))
    sizes = F.transform(
        F.arrays_zip(F.col("ms"), F.col("heads"), F.col("bodies")),
        lambda z: F.struct(
            F.length(z["heads"]).alias("h"), F.length(z["bodies"]).alias("b"),
            (z["ms"]["role"] == F.col("speaker")).alias("own"),
        ),
    )
    spans = F.aggregate(
        "sizes",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, z: F.struct(
            (a["at"] + z["h"] + z["b"]).alias("at"),
            F.when(
                z["own"],
                F.concat(a["out"], F.array(F.concat((a["at"] + z["h"]).cast("string"), F.lit(":"), (a["at"] + z["h"] + z["b"]).cast("string")))),
            ).otherwise(a["out"]).alias("out"),
        ),
    )
    return (
        both.select("conv", "seg", "speaker", "ms", heads.alias("heads"), bodies.alias("bodies"))
        .withColumn("sizes", sizes)
        .withColumn("mask", spans["out"])
        .select(
            F.col("conv").alias(conv_col), "speaker", F.col("seg").alias("segment"),
            F.array_join(F.zip_with("heads", "bodies", lambda a, b: F.concat(a, b)), "").alias("rendered"),
            F.array_join("mask", ",").alias("mask"),
            F.size("ms").cast("long").alias("n_turns"), F.size("mask").cast("long").alias("n_masked"),
        )
    )
