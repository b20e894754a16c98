"""Multi-party perspective rotation of dialogues, in SQL expressions only.

For each speaker of a dialogue the whole dialogue is rendered once: that speaker's turns as `assistant`, turns of the
others as `user` with their name, turns of system roles as `system` for all. The mask has the stretches of the rendered
text (in characters, end exclusive) that the assistant is trained on: what it says and the end mark behind it.

A dialogue may have a third of all rows, so it is rendered in chunks of `CHUNK` turn numbers; the texts of a dialogue's
chunks in order make the whole, and masks count from their chunk's start. Only one chunk is ever held together.

Defined cases: turns come in order of number, null numbers in a last chunk of their own; turns of one number in order of
role and text; turns equal in all four columns count once; a null role is the speaker `unknown`, a null text is empty;
each row without a dialogue id is a dialogue of its own; a dialogue of system turns only has no speaker and no row.
Marks inside texts and names are broken up, so that a text cannot end its own turn. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64
SYSTEM = ("system", "developer")
NAMELESS = "unknown"
START, END = "<|im_start|>", "<|im_end|>"
LAST = (1 << 63) - 1


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _head(turn: Column, speaker: Column) -> Column:
    name = F.replace(_plain(turn["role"]), F.lit("\n"), F.lit(" "))
    who = F.when(turn["role"] == speaker, F.lit("assistant")).when(turn["role"].isin(*SYSTEM), F.lit("system")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(START), who, F.lit("\n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, speaker, chunk, n_turns, text, mask: array of start and end)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(NAMELESS)).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(LAST)).cast("long"))
    turn = F.struct(F.coalesce("turn", F.lit(LAST)).alias("turn"), "role", "text")
    known = rows.where("conv_id is not null")
    chunks = known.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    speakers = known.where(~F.col("role").isin(*SYSTEM)).select("conv_id", F.col("role").alias("speaker")).distinct()
    alone = rows.where(F.col("conv_id").isNull() & ~F.col("role").isin(*SYSTEM))
    views = chunks.join(speakers, "conv_id").unionByName(alone.select("conv_id", "chunk", F.array(turn).alias("turns"), F.col("role").alias("speaker")))

    parts = F.transform("turns", lambda t: F.struct(
        _head(t, F.col("speaker")).alias("head"), F.concat(_plain(t["text"]), F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    views = views.withColumn("parts", parts)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def add(done: Column, part: Column) -> Column:
        first = done["at"] + F.length(part["head"])
        end = first + F.length(part["body"])
        span = F.array(F.struct(first.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(part["own"], F.concat(done["mask"], span)).otherwise(done["mask"]).alias("mask"))

    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return views.select("conv_id", "speaker", "chunk", F.size("turns").alias("n_turns"), text.alias("text"), F.aggregate("parts", start, add, lambda d: d["mask"]).alias("mask"))
