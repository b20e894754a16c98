"""News ingestion, tagging, cleaning, de-duplication, capping and release calendars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import dates, text
from barline.operators import feeds, similarity, tagging
from barline.operators.ranking import first_k
from barline.sources import dims


def kept_entries(items: DataFrame, feed_dim: DataFrame, now: datetime) -> DataFrame:
    """Age and noise filters, per-feed cap, first title wins - in this order."""
    entries = feeds.clean_titles(feeds.fresh_entries(items.join(feed_dim, "feed"), now))
    return feeds.first_title_wins(feeds.cap_per_feed(feeds.item_fields(entries)))


def ingest(items: DataFrame, feed_dim: DataFrame, now: datetime) -> DataFrame:
    """Kept entries under the overall cap."""
    return feeds.overall_cap(kept_entries(items, feed_dim, now))


def tag(items: DataFrame, watchlist: DataFrame, key: list[str]) -> DataFrame:
    return tagging.tag_items(items, watchlist, key)


# ---- cleaning --------------------------------------------------------------

def cleaning_flags(items: DataFrame, cutoff: Column) -> DataFrame:
    """Fix words, strip market sentences and flag the rows to drop."""
    fixed = items.withColumns({c: text.fix_words(F.col(c)) for c in ("headline", "body")})
    dated = ~F.col("block").isin(dims.UNDATED_BLOCKS)
    stale = dated & text.is_stale(F.coalesce("source_date", F.lit("")), cutoff)
    flagged = fixed.withColumns({
        "is_stale": stale, "is_market": ~stale & F.coalesce(text.is_market_headline(F.col("headline")), F.lit(False)),
        "_body": text.strip_market_sentences(F.col("body")),
    })
    kept = ~F.col("is_stale") & ~F.col("is_market")
    return flagged.withColumn("body_cut", kept & (F.col("_body") != F.col("body"))).withColumn(
        "body", F.col("_body")).drop("_body")


def clean(items: DataFrame, cutoff: Column) -> DataFrame:
    flagged = cleaning_flags(items, cutoff)
    return flagged.filter(~F.col("is_stale") & ~F.col("is_market")).drop("is_stale", "is_market", "body_cut")


def quality_counters(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count_if("is_stale").alias("stale"), F.count_if("is_market").alias("market_head"),
        F.count_if("body_cut").alias("market_sent"),
    )


# ---- de-duplication --------------------------------------------------------

def dedup_key(headline: Column, body: Column) -> Column:
    """Tokens of the headline and the body's first 80 characters (the rule's own key)."""
    return text.news_tokens(F.concat_ws(" ", F.coalesce(headline, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(80))))


def block_order(block: Column, region: Column) -> Column:
    """Position of an item's block; regional blocks follow all list blocks, in region order."""
    lists = F.array(*[F.lit(b) for b in dims.NEWS_BLOCKS])
    regions = F.array(*[F.lit(r) for r in dims.NEWS_REGIONS])
    return F.when(
        block == dims.REGIONAL_BLOCK, F.lit(len(dims.NEWS_BLOCKS)) + F.coalesce(F.array_position(regions, region), F.lit(0))
    ).otherwise(F.array_position(lists, block)).cast("int")


def dedup(items: DataFrame) -> DataFrame:
    """Greedy cross-block de-duplication per as-of day; clean-only blocks pass untouched."""
    watched = F.col("block").isin(dims.NEWS_BLOCKS + [dims.REGIONAL_BLOCK])
    keyed = items.filter(watched).withColumns({
        "block_pos": block_order(F.col("block"), F.col("region")),
        "tokens": dedup_key(F.col("headline"), F.col("body")),
    })
    kept = similarity.keep_first(keyed, ["as_of"], ["block_pos", "pos"]).drop("block_pos", "tokens")
    return kept.unionByName(items.filter(~watched))


def duplicate_counter(items: DataFrame, kept: DataFrame) -> DataFrame:
    """How many items the de-duplication dropped: the fourth number of the quality report."""
    counts = items.agg(F.count("*").alias("_all")).crossJoin(kept.agg(F.count("*").alias("_kept")))  # one row each
    return counts.select((F.col("_all") - F.col("_kept")).alias("duplicates"))


def previous_value(rows: DataFrame, group: str, pos: str, value: str, out: str, step: int = 4096) -> DataFrame:
    """Add the value of the row before in each group, by whole-number position. A group is cut into slices of `step`
    positions; a slice's first row takes the last row of the slice before it."""
    sliced = rows.withColumn("_slice", F.floor(F.col(pos) / step))
    inside = F.lag(value).over(W.partitionBy(group, "_slice").orderBy(pos))
    first = F.row_number().over(W.partitionBy(group, "_slice").orderBy(pos)) == 1
    placed = sliced.withColumns({out: inside, "_first": first})
    lasts = sliced.groupBy(group, "_slice").agg(F.max_by(value, pos).alias("_last"))
    carried = lasts.select(group, "_slice", F.lag("_last").over(W.partitionBy(group).orderBy("_slice")).alias("_before"))
    return placed.join(carried, [group, "_slice"]).withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(out))).drop(
        "_slice", "_first", "_before")


def cap_blocks(items: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """At most cap items per as-of day, block and region; blocks without a cap stay whole."""
    caps = dims.BLOCK_CAPS if caps is None else caps
    limits = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    capped = first_k(items.filter(F.col("block").isin(list(caps))), ["as_of", "block", "region"], [F.col("pos")],
                     max(caps.values()), out="_place")
    short = capped.filter(F.col("_place") <= limits[F.col("block")]).drop("_place")
    return short.unionByName(items.filter(~F.col("block").isin(list(caps))))


# ---- release calendar ------------------------------------------------------

def upcoming_reports(calendar: DataFrame, watch: DataFrame, now: datetime) -> DataFrame:
    """Watched names reporting on the next market session after the last anchor."""
    target = dates.next_session(dates.moment(now))
    return calendar.filter(F.col("report_date") == target).join(watch.select("ticker").distinct(), "ticker", "left_semi").select(
        "ticker", "report_date", dates.report_timing(F.col("hour")).alias("timing")
    )


def allowed_sources(items: DataFrame, allow: DataFrame, deny: DataFrame) -> DataFrame:
    return items.join(allow, "source", "left_semi").join(deny, "source", "left_anti")
