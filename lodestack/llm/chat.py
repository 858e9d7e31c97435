"""Chat formatting: every participant's view of a dialogue, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Speakers whose turns stay as they are in every view, and who have none of their own.
INSTRUCTIONS = ("system",)
#: Turn numbers of a chunk (a power of two), and turns of a part of it: what is held together at once.
CHUNK_TURNS, PART_TURNS = 64, 256
#: The name of a speaker whose role is null or blank.
NOBODY = "unknown"

_WHITE = " \t\n\x0b\x0c\r"


def safe_text(text: Column) -> Column:
    """The text with turn markers inside it broken up, so that it can't end its turn."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "< |$1| >")


def _speaker() -> Column:
    speaker = F.btrim("role", F.lit(_WHITE))
    return F.when(F.length(speaker) > 0, speaker).otherwise(NOBODY)


def _turns(turns: DataFrame) -> DataFrame:
    """Parts of dialogues: conv_id, chunk, slice, part and their turns in order.

    Turns are dealt out by dialogue and chunk, so a dialogue of any length is spread over tasks, and
    sorted there; no more than PART_TURNS are gathered in a row.
    """
    said = F.concat(safe_text(F.coalesce("text", F.lit(""))), F.lit("<|im_end|>"))
    rows = turns.select("conv_id", "turn", _speaker().alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), said.alias("body"))
    chunk = F.shiftright("turn", CHUNK_TURNS.bit_length() - 1).cast("bigint")
    loose = F.when(F.col("turn").isNull(), F.substring(F.md5(F.concat("speaker", "text").cast("binary")), 1, 2)).otherwise("")
    rows = rows.select("*", chunk.alias("chunk"), loose.alias("slice"))
    order = Window.partitionBy("conv_id", "chunk", "slice").orderBy("turn", "speaker", "text")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("part", F.floor((F.col("_n") - 1) / PART_TURNS))
    return rows.groupBy("conv_id", "chunk", "slice", "part").agg(F.sort_array(F.collect_list(F.struct("_n", "speaker", "body"))).alias("turns"))


def rotate(turns: DataFrame, instructions: tuple[str, ...] = INSTRUCTIONS) -> DataFrame:
    """One row per dialogue, participant and part: conv_id, perspective, chunk, slice, part, n_turns, offset, text, spans.

    turns: conv_id, turn, role (the speaker) and text; other columns are not read. In text, perspective's
    turns are the assistant's, others' are users' with their names, instructions' the system's. A view of
    a whole dialogue is the text of its parts in the order of chunk (null last), slice and part; up to
    CHUNK_TURNS turns from 0 on are one part. offset is where a part starts in the whole view, and spans
    are the places there (start, length in code points) of what is learned: the assistant's words and the
    marker that ends them. No part needs another one to be read.

    Turns of one number stand in the order of speaker and text, repeated rows each for itself; turns
    without a number come in slices of their own, by a hash, with a null chunk. Null text is empty, a
    null or blank role is NOBODY's. A null conv_id is a dialogue like any other. A dialogue of
    instructions alone has no participant and gives no row, as does an empty table.
    """
    parts = _turns(turns)
    place = ["chunk", "slice", "part"]
    people = turns.select(F.col("conv_id").alias("_conv"), _speaker().alias("perspective")).distinct()
    people = people.where(~F.col("perspective").isin(*instructions))

    def head(t: Column) -> Column:
        name = F.regexp_replace(t["speaker"], r"[\x00-\x20<>|]+", "_")
        own = t["speaker"] == F.col("perspective")
        role = F.when(t["speaker"].isin(*instructions), "system").when(own, "assistant").otherwise(F.concat(F.lit("user name="), name))
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))

    # the length of every part in every view tells where it starts; only these numbers are ordered by dialogue
    short = parts.select("conv_id", *place, F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), F.length(t["body"]).alias("n"))).alias("turns"))
    size = F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + F.length(head(t)) + t["n"] + 1)
    starts = short.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("_conv", "perspective", *place, size.alias("_size"))
    order = Window.partitionBy("_conv", "perspective").orderBy(F.asc_nulls_last("chunk"), "slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_conv", "perspective", *(F.col(c).alias(f"_{c}") for c in place), F.coalesce(F.sum("_size").over(order), F.lit(0)).alias("offset"))
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("chunk").eqNullSafe(F.col("_chunk")) & (F.col("slice") == F.col("_slice")) & (F.col("part") == F.col("_part"))
    views = parts.join(starts, here).select("conv_id", "perspective", *place, "offset", "turns")

    def said(t: Column) -> Column:
        return F.struct(head(t).alias("head"), t["body"].alias("body"), (t["speaker"] == F.col("perspective")).alias("own"))

    views = views.withColumn("_said", F.transform("turns", said))
    none = F.array().cast("array<struct<start:bigint,length:int>>")

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["head"])
        span = F.array(F.struct(start.alias("start"), F.length(m["body"]).alias("length")))
        return F.struct((start + F.length(m["body"]) + 1).alias("at"), F.when(m["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("_said", F.struct(F.col("offset").alias("at"), none.alias("spans")), add, lambda s: s["spans"])
    text = F.array_join(F.transform("_said", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "")
    return views.select("conv_id", "perspective", *place, F.size("turns").cast("bigint").alias("n_turns"), "offset", text.alias("text"), spans.alias("spans"))
