"""Perspective rotation of dialogues: each participant in turn is the assistant, the others are named users.

A turn reads `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. ROLE is `assistant` for the speaker whose perspective it is,
`user name=SPEAKER` for others, and `system` for turns of a system speaker, which is no participant. The mask
holds the spans of TEXT and its end mark in the turns of the assistant. Only DataFrame functions.

A dialogue may be very long, so it is rendered in parts of a bounded range of turn numbers. Turns without a number, or with the same
one, may still be many: a part of more turns than that range is cut into rows of so many turns, by their numbers in a
sort of such parts over all tasks. char_start gives a row's place in the whole, and joining the rows in its order gives the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.llm.tables import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART = 64


def _safe(text: Column) -> Column:
    """Marks inside texts lose their meaning: `<|` reads `< |`."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _in_pieces(said: DataFrame, part: int) -> DataFrame:
    """`said` with `piece`: from 0, the number of each `part` turns of a `place`, in the order of turn, role and text."""
    # Equal turns are told apart by a number, so that they need not lie in one task.
    order = said.withColumn("_tie", F.monotonically_increasing_id()).orderBy("place", "turn", "role", "text", "_tie").drop("_tie")
    numbered = cut_lineage(order.withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumns({"_task": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)})
    tasks = numbered.groupBy("place", "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("place").orderBy("_task")) - F.col("_n")
    placed = numbered.join(tasks.select("place", "_task", (before - F.col("_first")).alias("_shift")), ["place", "_task"])
    return placed.withColumn("piece", F.floor((F.col("_row") + F.col("_shift")) / part).cast("long")).select(*said.columns, "piece")


def rotate(turns: DataFrame, system: str = "system", part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_target, text, mask, char_start) for each participant of each dialogue and part.

    `turns` has conv_id, turn, role and text. Turns are in the order of turn, then role, then text; a turn without a
    number belongs to part -1, before all others, a null conv_id is a dialogue of its own. A null role is the speaker
    `unknown`, a null text is empty. A dialogue without participants (only system turns) gives no rows. Repeated rows are
    repeated turns. `part` is the range of turn numbers in a part, and the most turns in a row: a
    part with more gives several rows, in the order of char_start. mask: array of (start, end), in characters from the start
    of the row, in ascending order; n_target: characters in it. Other columns are ignored.
    """
    said = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _safe(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))).alias("role"),
        _safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long"))
    speakers = said.where(F.col("role") != system).groupBy("conv_id", F.col("role").alias("perspective")).agg(F.count("*").alias("own"))
    said = said.withColumn("place", F.struct("conv_id", "part"))
    crowded = stored(said.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > part).select("place", F.lit(True).alias("crowded")), "crowded")
    said = said.join(crowded, "place", "left")
    pieces = said.where("crowded is null").drop("crowded").withColumn("piece", F.lit(0).cast("long")).unionByName(_in_pieces(said.where("crowded").drop("crowded"), part))
    parts = pieces.groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = parts.join(speakers.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def head(t: Column) -> Column:
        name = F.when(t["role"] == F.col("perspective"), F.lit("assistant")).when(t["role"] == system, F.lit("system")).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    pieces = both.withColumn(
        "pieces", F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("body"), (t["role"] == F.col("perspective")).alias("target")))
    )
    walk = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE) + 1).alias("at"),
            F.when(
                p["target"],
                F.concat(
                    acc["mask"],
                    F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("end"))),
                ),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    shown = pieces.select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "").alias("text"),
        walk["mask"].alias("mask"),
    )
    shown = shown.withColumn("n_target", F.aggregate("mask", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    # Places in the whole come from a table of lengths, so that the texts of a dialogue are never one task.
    key = F.struct("conv_id", "perspective", "part", "piece").alias("key")
    length = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE) + 1)
    start = F.sum("n").over(W.partitionBy("key.conv_id", "key.perspective").orderBy("key.part", "key.piece")) - F.col("n")
    starts = pieces.select(key, length.alias("n")).select("key", start.alias("char_start"))
    shown = shown.select(key, "*").join(starts, "key")
    return shown.select("conv_id", "perspective", "part", "n_turns", "n_target", "text", "mask", "char_start")
