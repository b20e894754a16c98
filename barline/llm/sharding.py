"""Sharding by jump consistent hashing, in SQL expressions only.

A key jumps upward through the shard numbers; each jump is drawn from a hash of the key and the shard it leaves, so the
walk is the same whatever the number of shards, and a key's shard is where it stands before the first jump past the
last one. With one more shard a key either stays or goes to the new one. No ring and no table is kept.

Slots number the rows of a shard without gaps. A shard is dealt into `LANES` lanes by a hash of the key; lanes are
numbered side by side and each starts where the one before ends, so no task sorts a whole shard.

Defined cases: a null text has no bytes (size 1, CRC 0); all null ids are the key of the empty string; repeated rows all
get a slot. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANES = 256


def draw(*parts: Column) -> Column:
    """32 bits of the MD5 of parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def jump(key: Column, shards: int) -> Column:
    """The shard of a string key, from 0. It takes `shards` jumps at most, as each goes up."""

    def step(walk: Column, _: Column) -> Column:
        at = walk["next"]
        fraction = F.shiftright(draw(key, at.cast("string")), 1) + 1  # of 2**31
        further = F.floor((at + 1) * F.lit(1 << 31) / fraction)
        return F.when(at < shards, F.struct(at.alias("at"), further.alias("next"))).otherwise(walk)

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda walk: walk["at"]).cast("int")


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    lane = draw(key, F.lit("lane")) % LANES
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        jump(key, shards).alias("shard"), jump(key, shards + 1).alias("grown_shard"), lane.alias("lane"))
    counts = docs.select(jump(key, shards).alias("shard"), lane.alias("lane")).groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("shard", "lane", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("inside", inside).join(F.broadcast(firsts), ["shard", "lane"])  # shards * LANES rows at most
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard")
