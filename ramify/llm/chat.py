"""Multi-party dialogues, rendered once from the view of every participant.

In the rendering for one speaker that speaker is the assistant and its turns are what a
model learns from; all others are users with their names. Narrators, such as a system
prompt, are context for all and no participants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.operators.ranking import grouped_running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BLOCK_TURNS = 64
UNKNOWN = "unknown"


def _name(speaker: Column) -> Column:
    plain = F.regexp_replace(speaker, r"[\s<>|]+", "_")
    return F.when(speaker.isNull() | (speaker == ""), UNKNOWN).otherwise(plain)


def rotate_perspectives(turns: DataFrame, narrators: Sequence[str] = ("system",), block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, block, n_turns, text, mask: one row per participant and block.

    Turns go by turn, role and text; block b holds turns b * ``block_turns`` and on, so
    that no row holds a dialogue of any length. mask is an array of (start, end) in
    characters of text, from 0, end excluded: the assistant's words and its closing mark.

    A null or empty role is the participant "unknown"; names lose white space and mark
    characters, and names that become equal are one participant. "<|" inside a text
    becomes "< |". A null text is empty; a null conv_id is a dialogue of its own; repeated
    rows are repeated turns; other columns are ignored. A dialogue of narrators only, and
    an empty table, give no rows.
    """
    said = turns.select(
        "conv_id",
        "turn",
        _name(F.col("role")).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    )
    ranked = grouped_running(said, ["conv_id"], ["turn", "speaker", "said"], "at")
    participants = said.filter(~F.col("speaker").isin(list(narrators))).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    views = ranked.join(participants, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, "assistant").when(F.col("speaker").isin(list(narrators)), F.col("speaker")).otherwise(F.concat(F.lit("user name="), "speaker"))
    rendered = views.select(
        "conv_id",
        "perspective",
        F.expr(f"(at - 1) div {block_turns}").alias("block"),
        F.struct("at", F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat("said", F.lit(CLOSE)).alias("body"), own.alias("own")).alias("t"),
    )
    blocks = rendered.groupBy("conv_id", "perspective", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # Goes over the turns with the number of characters so far and the spans.
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["n"] + F.length(t["head"]) + F.length(t["body"]) + 1).alias("n"),
            F.when(
                t["own"],
                F.concat(a["spans"], F.array(F.struct((a["n"] + F.length(t["head"])).alias("start"), (a["n"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return blocks.select(
        "conv_id",
        "perspective",
        "block",
        F.size("t").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "").alias("text"),
        spans.alias("mask"),
    )
