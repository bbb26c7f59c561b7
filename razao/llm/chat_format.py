"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that
speaker as the assistant and all others as named users; the loss mask covers
the assistant's words and their end marks.  A long dialogue is rendered in
consecutive parts of ``PART`` rows by rank, so that no conversation, however
long or often repeated, has to fit into one task; every participant gets all
parts, also those in which it is silent.  DataFrame operations only.

Defined results: a null role speaks as ``unknown``; a null text is empty; a
null conversation id is a conversation of its own; turns are sorted by number,
then role, then text, and repeated rows are kept; a row without a turn number
has no place in a dialogue and is a dialogue of its own, without a part number;
parts are numbered on from that of the first turn (its number by ``PART``);
marks inside a text are made harmless by a blank after ``<``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.records import consecutive_index

#: turns of one rendered part
PART = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(conversations: DataFrame, part: int = PART) -> DataFrame:
    """``(conv_id, part, speaker, n_turns, n_own_turns, rendered, spans)``.

    ``spans`` are the masked ``(start, end)`` code points of ``rendered``.
    """
    role = F.regexp_replace(F.coalesce(F.col("role"), F.lit("unknown")), r"[\r\n]", " ")
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        "conv_id", turn.alias("turn"), F.replace(role, F.lit("<|"), F.lit("< |")).alias("role"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    rows = rows.withColumn("loose", F.when(F.col("turn").isNull(), F.xxhash64("role", "text"))) \
        .withColumn("tie", F.monotonically_increasing_id())
    # ranks from one range-partitioned order: rows of one turn spread as well
    placed = consecutive_index(rows, ["conv_id", "turn", "loose", "role", "text", "tie"], start=0, name="at")
    dialogues = placed.groupBy(F.col("conv_id").alias("c"), F.col("loose").alias("l")).agg(
        F.min("at").alias("first"), F.floor(F.min("turn") / part).cast("long").alias("start"),
        F.collect_set("role").alias("speakers"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("loose").eqNullSafe(F.col("l"))
    parts = (placed.join(dialogues.select("c", "l", "first"), same)
             .groupBy("conv_id", "loose", F.floor((F.col("at") - F.col("first")) / part).cast("long").alias("chunk"))
             .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))
    views = parts.join(dialogues.select("c", "l", "start", "speakers"), same).select(
        "conv_id", (F.col("start") + F.col("chunk")).alias("part"), "turns",
        F.explode(F.array_sort("speakers")).alias("speaker"))

    def own(t: Column) -> Column:
        return t["role"] == F.col("speaker")

    pieces = F.transform("turns", lambda t: F.struct(
        own(t).alias("own"),
        F.when(own(t), F.lit(f"{OPEN}assistant\n")).otherwise(
            F.concat(F.lit(f"{OPEN}user name="), t["role"], F.lit("\n"))).alias("head"),
        F.concat(t["text"], F.lit(CLOSE)).alias("body")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("pos"),
                        F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return views.withColumn("pieces", pieces).select(
        "conv_id", "part", "speaker", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", F.struct(F.lit(0).alias("pos"), none.alias("spans")), step,
                    lambda acc: acc["spans"]).alias("spans"))


def digest(rotated: DataFrame) -> DataFrame:
    """Rendered text with its mask as text and the number of masked characters."""
    return rotated.select(
        "conv_id", "part", "speaker", "n_turns", "n_own_turns", "rendered",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))),
                     ",").alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_masked"))
