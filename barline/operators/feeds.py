"""Feed entry operators: age, noise, per-feed caps, first title wins, overall cap."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import text
from barline.functions.dates import moment
from barline.operators.ranking import first_k
from barline.sources.dims import RSS_TOTAL_CAP


def fresh_entries(items: DataFrame, now: datetime) -> DataFrame:
    """Entries no older than their feed's age limit; undated entries pass."""
    oldest = moment(now) - F.make_dt_interval(hours=F.col("max_age_h"))
    return items.filter(F.col("published").isNull() | (F.col("published") >= oldest))


def clean_titles(items: DataFrame) -> DataFrame:
    """Drop empty and noise titles."""
    title = text.strip(F.coalesce("title", F.lit("")))
    return items.withColumn("title", title).filter((F.length("title") > 0) & ~text.is_noise(F.col("title")))


def item_fields(items: DataFrame) -> DataFrame:
    """Inner source, cut title, cleaned summary and the weekly / long-form flags."""
    inner = F.nullif("inner_source", F.lit(""))
    return items.select(
        "feed", "feed_pos", "pos",
        text.cut_source_suffix(F.col("title"), inner).alias("title"),
        text.clean_summary(F.col("summary")).alias("summary"), "link",
        F.coalesce(inner, F.col("feed")).alias("source"),
        (F.col("max_age_h") > 72).alias("weekly"), "longform", "published", "max_items",
    )


def cap_per_feed(items: DataFrame, slices: int = 64) -> DataFrame:
    """The first max_items entries of each feed. Slices of a feed are cut first, so a feed with a third of all entries
    reaches one task with `slices` times its limit at most."""
    limit = F.col("_kept") <= F.col("max_items")
    sliced = items.withColumn("_slice", F.pmod(F.xxhash64("pos"), F.lit(slices)))
    parts = sliced.withColumn("_kept", F.row_number().over(W.partitionBy("feed", "_slice").orderBy("pos"))).filter(limit)
    return parts.withColumn("_kept", F.row_number().over(W.partitionBy("feed").orderBy("pos"))).filter(limit).drop("_kept", "_slice")


def first_title_wins(items: DataFrame) -> DataFrame:
    keyed = items.withColumn("title_key", text.title_key(F.col("title")))
    return first_k(keyed, ["title_key"], [F.col("feed_pos"), F.col("pos")], 1, out="_kept").drop("_kept")


def overall_cap(items: DataFrame, cap: int = RSS_TOTAL_CAP) -> DataFrame:
    return items.orderBy("feed_pos", "pos").limit(cap)


def feed_counts(items: DataFrame) -> DataFrame:
    """Entries kept of each feed; the count stands before the overall cap."""
    return items.groupBy("feed").agg(F.count("*").alias("kept"))


def group_by_feed(items: DataFrame) -> DataFrame:
    """One row per feed of a capped item list (at most max_items entries each)."""
    return items.groupBy("feed").agg(
        F.min(F.struct("feed_pos", "pos")).alias("first_seen"), F.bool_or("weekly").alias("weekly"),
        F.sort_array(F.collect_list(F.struct("pos", "title", "source"))).alias("items"),
    )
