"""Nested documents: model replies, defaults, regime snapshots and their review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions.text import json_body, mend_commas
from barline.schemas import FALSIFIERS
from barline.sources.dims import CODE_CAPS


def parse_replies(replies: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Parsed replies; `doc` is null and `is_broken` set where nothing can be read.

    A reply that parses is left alone; only one that does not has its commas mended, and is parsed once more.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parse = lambda c: F.from_json(c, f"{schema}, _corrupt string", options)
    failed = lambda doc: F.col(doc).isNull() | F.col(f"{doc}._corrupt").isNotNull()
    first = replies.withColumn("_json", json_body(F.col(text))).withColumn("_first", parse(F.col("_json")))
    parsed = first.withColumn("doc", F.when(failed("_first"), parse(mend_commas(F.col("_json")))).otherwise(F.col("_first")))
    return parsed.withColumn("is_broken", failed("doc")).drop("_json", "_first")


def with_defaults(doc: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing fields filled; absent columns are added."""
    return doc.withColumns({
        name: F.coalesce(F.col(name), value) if name in doc.columns else value for name, value in defaults.items()
    })


def regime_defaults() -> dict[str, Column]:
    """What an absent regime document holds."""
    texts = {c: F.lit("") for c in ("call", "for_ranking", "confidence", "confidence_reason")}
    lists = {c: F.array().cast("array<string>") for c in ("confirms", "contradicts")}
    falsifiers = F.array().cast(FALSIFIERS)
    return {**texts, **lists, "falsifiers": falsifiers, "verdict": F.lit("無前日資料")}


# Text blocks of a daily document with their fields and the defaults that are not blank.
TEXT_BLOCKS: dict[str, dict[str, str]] = {
    "market_pulse": dict.fromkeys(["dominant_theme", "hidden_risk", "hidden_opportunity", "key_level_to_watch",
                                   "historical_analog", "new_pattern"], ""),
    "index_factor_reading": dict.fromkeys(["market_breadth", "style_rotation", "sector_signal", "nyfang_signal",
                                           "momentum_read", "key_insight"], ""),
    "sentiment_analysis": dict.fromkeys(["vix_reading", "vvix_reading", "skew_reading", "fear_greed_reading", "credit_check",
                                         "cross_asset_confirm", "key_divergence", "reliability_reason", "one_line"], "")
    | {"stage": "無明確訊號", "stage_name": "正常市場", "reliability": "中"},
}
# List blocks, and the ones cut or emptied.
LIST_BLOCKS = ["top_stories", "macro", "ai_industry", "fintech_crypto", "geopolitical", "world_news", "tech_trends", "startup_news",
               "earnings_preview", "watchlist_news", "weekend_reads", "daily_deep_dive", "today_events"]
EMPTIED_BLOCKS = ["implied_trends"]

# Text fields and list fields of a weekly theme document.
WEEKLY_TEXT = {
    "earnings": ["sector_trends"], "options": ["skew_positioning", "gamma_environment", "nq_signal"],
    "commodities": ["agriculture", "macro_signal"], "central_bank": ["rate_market", "nq_implication"],
    "credit": ["credit_conditions", "stress_signals", "leading_indicator"], "liquidity": ["liquidity_signal", "nq_implication"],
}
WEEKLY_LISTS = {"earnings": ["earnings_results", "next_week_earnings"], "options": ["key_levels"], "commodities": ["next_week_catalysts"],
                "central_bank": ["other_cb", "next_week_events"], "credit": [], "liquidity": []}
OTHER_TEXT, OTHER_LISTS = ["signal_change", "watchlist_impact"], ["deep_analysis", "earnings_calls", "analyst_views", "next_week_catalysts"]


def filled_struct(value: Column, defaults: dict[str, str]) -> Column:
    """Every field of a struct with its default."""
    return F.struct(*[F.coalesce(value[name], F.lit(text)).alias(name) for name, text in defaults.items()])


def daily_document(doc: DataFrame) -> DataFrame:
    """A parsed daily document with all blocks present: lists empty, texts at their defaults,
    world news cut to three, retired blocks emptied."""
    lists = {b: F.coalesce(F.col(b), F.array()) if b in doc.columns else F.array().cast("array<string>") for b in LIST_BLOCKS}
    lists["world_news"] = F.slice(lists["world_news"], 1, CODE_CAPS["world_news"])
    texts = {b: filled_struct(F.col(b), d) if b in doc.columns else F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
             for b, d in TEXT_BLOCKS.items()}
    retired = {b: F.array().cast("array<string>") for b in EMPTIED_BLOCKS}
    return with_defaults(doc.withColumns({**lists, **texts, **retired}), {"daily_summary": F.lit(""), "alert": F.lit("")})


def weekly_document(doc: DataFrame, theme: str, name: str) -> DataFrame:
    """A parsed weekly theme document with the fields of its theme."""
    texts = {c: F.lit("") for c in ["week_summary", *WEEKLY_TEXT.get(theme, OTHER_TEXT)]}
    lists = {c: F.array().cast("array<string>") for c in ["risk_flags", *WEEKLY_LISTS.get(theme, OTHER_LISTS)]}
    flags = {"has_earnings": F.lit(False)} if theme == "earnings" else {}
    return with_defaults(doc, {"theme": F.lit(name), **texts, **lists, **flags})


def trend_defaults(items: Column, keep: int = 3) -> Column:
    """Trend entries with label and list defaults, sub-items capped."""
    return F.transform(items, lambda t: F.struct(
        t["title"].alias("title"), F.coalesce(t["label_type"], F.lit("other")).alias("label_type"),
        F.slice(F.coalesce(t["sub_items"], F.array().cast("array<string>")), 1, keep).alias("sub_items"),
    ))


def theme_documents(replies: DataFrame, schema: str) -> DataFrame:
    """The newest readable reply of each (as_of, theme) with its defaults: replies (as_of, theme, at, text)."""
    parsed = parse_replies(replies, schema).filter(~F.col("is_broken"))
    newest = parsed.groupBy("as_of", "theme").agg(F.max_by("doc", "at").alias("doc"))
    fields = newest.select("as_of", "theme", "doc.*").drop("_corrupt")
    return with_defaults(fields, {"week_summary": F.lit(""), "risk_flags": F.array().cast("array<string>")})


def regime_as_of(regimes: DataFrame, days: DataFrame) -> DataFrame:
    """For each day of `days` (review_day) the newest regime before it, whole: an as-of lookup in one aggregation.

    A regime covers the days up to the next one's, so every day finds its own without a range join."""
    until = F.lead("as_of").over(W.orderBy("as_of"))  # one row per regime day
    spans = regimes.withColumn("_until", until).select(
        F.struct(*regimes.columns).alias("regime"), F.explode(F.sequence(
            F.date_add("as_of", 1), F.greatest(F.date_add("as_of", 1), F.coalesce("_until", F.date_add("as_of", 30))))).alias("review_day"))
    return spans.join(days, "review_day").groupBy("review_day").agg(F.max_by("regime", "regime.as_of").alias("regime"))


def latest_before(snapshots: DataFrame, today: Column, key: str = "as_of") -> DataFrame:
    """The newest snapshot before today: one as-of day's rows."""
    earlier = snapshots.filter(F.col(key) < today)
    newest = earlier.agg(F.max(key).alias(key))
    return earlier.join(F.broadcast(newest), key, "left_semi")  # newest is one row


def review_regime(regimes: DataFrame, readings: DataFrame) -> DataFrame:
    """Each falsifier of the previous regime against today's reading of its metric.

    regimes: (as_of, call, falsifiers); readings: (as_of, metric, value). Every regime is
    reviewed with the readings of the session right after it.
    """
    days = readings.select("as_of").distinct()
    nxt = days.select("as_of", F.lead("as_of").over(W.orderBy("as_of")).alias("review_day"))  # one row per day
    checks = regimes.join(nxt, "as_of").select(
        "as_of", "call", "review_day", F.explode("falsifiers").alias("f")
    ).select("as_of", "call", "review_day", F.col("f.metric").alias("metric"), F.col("f.op").alias("op"),
             F.col("f.threshold").alias("threshold"))
    today = readings.select(F.col("as_of").alias("review_day"), "metric", F.col("value").alias("today_value"))
    crossed = F.when(F.col("op") == ">", F.col("today_value") > F.col("threshold")).otherwise(
        F.col("today_value") < F.col("threshold"))
    return checks.join(today, ["review_day", "metric"], "left").withColumn(
        "hit", F.coalesce(crossed, F.lit(False)))


def review_verdict(checks: DataFrame) -> DataFrame:
    return checks.groupBy("as_of", "call", "review_day").agg(
        F.when(F.bool_or("hit"), "被證偽").otherwise("延續").alias("verdict"), F.count_if("hit").alias("hits")
    )
