"""Chat formatting by multi-party perspective rotation (operator 3, native).

Every participant of a conversation is the assistant once: its turns are what a model learns to
write, everyone else's turns are those of named users. A rendered dialogue is kept as one row a turn
with its character offset, so a conversation of any length stays spread over tasks; ``dialogues``
joins the turns of short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a turn. The assistant's text and the end mark after it are learnt.
ASSISTANT, USER, STOP = "<|assistant|>\n", "<|user name=%s|>\n", "<|end|>\n"
UNKNOWN = "unknown"
#: Consecutive turns that one task adds up.
RUN = 1024


def escaped(text: Column) -> Column:
    """The text with one more backslash inside each ``<|`` and ``|>``, so that it can't hold or end a frame.
    Taking one away again gives the text back."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|"), r"\|(\\*)>", r"|\\$1>")


def perspectives(turns: DataFrame, run: int = RUN) -> DataFrame:
    """One row for each turn (conv_id, turn, role, text) and each participant of its conversation.

    conv_id, perspective (who is the assistant), turn, position (rank of the turn, from 0), segment
    (the rendered turn), start (its first character in the dialogue), length, mask_start and
    mask_length (the learnt characters, within the dialogue; length 0 in other people's turns).

    Texts and names are ``escaped``, so nothing in them reads as a frame. A null role is the participant
    "unknown", a null text is empty, a null turn comes first, a null conv_id is a conversation of its
    own; equal turn numbers are ordered by md5 of role and text, and equal rows give equal segments at
    different places. Extra columns are ignored; an empty table gives no rows.

    Offsets are summed in three steps, over runs of turns, over the groups of a run (a turn number and
    the first two digits of that md5, so that even turns without numbers are spread) and in a group.
    """
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    own = own.withColumn("tie", F.md5(F.concat("role", F.lit(":"), "text").cast("binary"))).withColumn("part", F.substring("tie", 1, 2))
    # escaped once a turn, not once a perspective
    own = own.withColumn("shown", F.format_string(USER, escaped(F.col("role")))).withColumn("body", F.concat(escaped(F.col("text")), F.lit(STOP))).drop("text")
    people = own.groupBy("conv_key", "role").agg(F.lit(1).alias("one")).select("conv_key", F.col("role").alias("perspective"))
    rows = own.join(people, "conv_key")
    mine = F.col("role") == F.col("perspective")
    frame = F.when(mine, F.lit(ASSISTANT)).otherwise(F.col("shown"))
    rows = rows.withColumn("frame", F.length(frame)).withColumn("segment", F.concat(frame, "body")).withColumn("length", F.length("segment").cast("long"))
    rows = rows.withColumn("turn_key", F.coalesce("turn", F.lit(-(1 << 62)))).withColumn("run", F.floor(F.col("turn_key") / run).cast("long"))
    whole, single = ["conv_key", "perspective"], ["conv_key", "perspective", "turn_key", "part"]
    groups = rows.groupBy(*single, "run").agg(F.sum("length").alias("total"), F.count(F.lit(1)).alias("turns"))
    before = Window.partitionBy(*whole).orderBy("run")
    runs = groups.groupBy(*whole, "run").agg(F.sum("total").alias("all"), F.sum("turns").alias("n"))
    runs = runs.select(*whole, "run", (F.sum("all").over(before) - F.col("all")).alias("run_start"), (F.sum("n").over(before) - F.col("n")).alias("run_turns"))
    inner = Window.partitionBy(*whole, "run").orderBy("turn_key", "part")
    groups = groups.join(runs, [*whole, "run"]).select(
        *single, (F.col("run_start") + F.sum("total").over(inner) - F.col("total")).alias("group_start"), (F.col("run_turns") + F.sum("turns").over(inner) - F.col("turns")).alias("group_turns"),
    )
    within = Window.partitionBy(*single).orderBy("tie")
    placed = rows.join(groups, single)
    placed = placed.withColumn("start", F.col("group_start") + F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    placed = placed.withColumn("position", F.col("group_turns") + F.row_number().over(within) - 1)
    mask_start = F.when(mine, F.col("start") + F.col("frame")).otherwise(F.col("start"))
    mask = F.when(mine, F.col("length") - F.col("frame")).otherwise(F.lit(0))
    return placed.select("conv_id", "perspective", "turn", "position", "segment", "start", "length", mask_start.cast("long").alias("mask_start"), mask.cast("long").alias("mask_length"))


def dialogues(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks (array of start, end) for conversations that fit one row.

    A null conv_id is a conversation like any other; equal segments stand as often as they come; extra
    columns are left out; no segments give no rows.
    """
    row = F.struct("position", "segment", "mask_start", "mask_length")
    whole = segments.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    masks = F.transform(F.filter("rows", lambda r: r["mask_length"] > 0), lambda r: F.struct(r["mask_start"].alias("start"), (r["mask_start"] + r["mask_length"]).alias("end")))
    return whole.select("conv_id", "perspective", F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("text"), masks.alias("masks"))
