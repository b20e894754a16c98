"""Daily and weekly cross-asset dashboards and the macro, credit and option panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import numeric as num
from barline.functions import rules
from barline.functions.numeric import pct_change, ratio, rnd
from barline.operators import series
from barline.operators.ranking import first_k
from barline.sources import dims

ITEM = ["category", "pos", "key", "label", "value", "change", "unit", "dir", "is_dynamic", "val_str", "chg_str"]


def item_readings(points: DataFrame, instruments: DataFrame) -> DataFrame:
    """One row per instrument: `new` and `old` closes turned into value, change and direction.

    points: (symbol, old, new[, data_date]). Instruments without data stay, with nulls.
    """
    joined = instruments.join(points, "symbol", "left")
    unit = F.when(F.col("use_bps"), "bps").otherwise("pct")
    change = F.when(F.col("use_bps"), num.bps_change(F.col("new"), F.col("old"))).otherwise(
        pct_change(F.col("new"), F.col("old")))
    return joined.withColumns({"value": F.col("new"), "unit": unit, "change": change}).withColumns({
        "dir": num.direction(F.col("change"), F.col("invert")),
        "is_dynamic": F.col("pool").isNotNull(),
        "val_str": num.fmt_value(F.col("value"), F.col("prefix")),
        "chg_str": num.fmt_change(F.col("change"), F.col("unit")),
    })


def daily_points(closes: DataFrame) -> DataFrame:
    return series.last_two(series.drop_missing(closes)).select(
        "symbol", F.col("latest").alias("new"), F.col("previous").alias("old"), "data_date"
    )


def weekly_points(closes: DataFrame, calendar_year: bool = False) -> DataFrame:
    return series.week_first_last(series.drop_missing(closes), "symbol", calendar_year).select(
        "symbol", F.col("last").alias("new"), F.col("first").alias("old"), "data_date"
    )


def pool_picks(readings: DataFrame) -> DataFrame:
    """The largest absolute moves of each pool. A missing change counts 0; commodity and currency
    rows need a price, sector rows do not."""
    members = readings.filter(F.col("pool").isNotNull() & ((F.col("pool") == "sector") | F.col("value").isNotNull()))
    size = F.coalesce(F.abs("change"), F.lit(0.0))
    most = max(k for _, _, k, _ in dims.POOLS.values())
    top = first_k(members, ["pool"], [size.desc(), F.col("pos")], most, out="place")
    wanted = F.create_map(*[F.lit(x) for p, (_, _, k, _) in dims.POOLS.items() for x in (p, k)])
    return top.filter(F.col("place") <= wanted[F.col("pool")])


def pair_items(points: DataFrame) -> DataFrame:
    """Ratio and spread items from the latest and previous closes of two symbols."""
    spec = dims.literal_frame(
        points.sparkSession, dims.PAIRS,
        "key string, category string, kind string, left string, right string, label string, pos int",
    )
    side = lambda name: points.select(
        F.col("symbol").alias(name), F.col("new").alias(f"{name}_new"), F.col("old").alias(f"{name}_old"))
    wide = spec.join(side("left"), "left", "left").join(side("right"), "right", "left")
    is_ratio = F.col("kind") == "ratio"
    value = F.when(is_ratio, ratio(F.col("left_new"), F.col("right_new"))).otherwise(F.col("left_new") - F.col("right_new"))
    before = F.when(is_ratio, ratio(F.col("left_old"), F.col("right_old"))).otherwise(F.col("left_old") - F.col("right_old"))
    change = F.when(is_ratio, pct_change(F.col("value"), F.col("before"))).otherwise(
        num.bps_change(F.col("value"), F.col("before")))
    sign = F.when(F.col("value").isNull(), "neu").when(F.col("value") > 0, "pos").otherwise("neg")
    shown = F.when(is_ratio, num.shown(rnd(F.col("value"), 4), "0.0000")).otherwise(
        F.concat(num.shown(rnd(F.col("value"), 2), "0.00"), F.lit("%")))
    return wide.withColumns({"value": value, "before": before}).withColumns({
        "change": change, "unit": F.when(is_ratio, "pct").otherwise("bps"),
    }).select(
        "category", "pos", "key", "label", "value", "change", "unit",
        F.when(is_ratio, num.ratio_direction(F.col("change"))).otherwise(sign).alias("dir"),
        F.lit(False).alias("is_dynamic"), F.coalesce(shown, F.lit(num.MISSING)).alias("val_str"),
        num.fmt_change(F.col("change"), F.col("unit")).alias("chg_str"),
    )


def market_items(points: DataFrame, instruments: DataFrame) -> DataFrame:
    """All dashboard rows: fixed items, ratio and spread items, and the pool picks."""
    readings = item_readings(points, instruments)
    fixed = readings.filter(F.col("pool").isNull() & (F.col("category") != "ratio_leg"))
    picks = pool_picks(readings).withColumn("pos", F.lit(100) + F.col("place"))
    return (
        fixed.select(*ITEM).unionByName(picks.select(*ITEM)).unionByName(pair_items(points).select(*ITEM))
        .withColumns({"value": rnd(F.col("value"), 4), "change": rnd(F.col("change"), 4)})
    )


def market_daily(closes: DataFrame, instruments: DataFrame) -> DataFrame:
    return market_items(daily_points(closes), instruments)


def market_weekly(closes: DataFrame, instruments: DataFrame, calendar_year: bool = False) -> DataFrame:
    return market_items(weekly_points(closes, calendar_year), instruments)


def data_date(points: DataFrame, instruments: DataFrame) -> DataFrame:
    """Day of the first instrument (in category order) that has data, and the newest day of all."""
    order = F.array_position(F.array(*[F.lit(c) for c in dims.INSTRUMENTS]), F.col("category"))
    fixed = instruments.filter(F.col("pool").isNull()).join(points, "symbol").filter(F.col("data_date").isNotNull())
    return fixed.agg(
        F.min_by("data_date", F.struct(order, "pos")).alias("data_date"), F.max("data_date").alias("newest")
    )


# ---- sentiment and trends --------------------------------------------------

def history(closes: DataFrame, symbols: list[str], n: int) -> DataFrame:
    """(symbol, entries): the newest `n` values, two decimals, oldest first; needs two values."""
    rows = closes.filter(F.col("symbol").isin(symbols))
    tail = series.tail_array(series.drop_missing(rows), "symbol", n, "close")
    entries = F.transform("tail", lambda e: F.struct(e["dt"].alias("dt"), rnd(e["close"], 2).alias("val")))
    return tail.select("symbol", entries.alias("entries")).filter(F.size("entries") >= 2)


def sentiment_history(closes: DataFrame, n: int = 5, weekly: bool = False) -> DataFrame:
    """Trend and peak of each sentiment series over its last values."""
    if weekly:
        closes = series.weekly(series.drop_missing(closes)).select("symbol", F.col("week").alias("dt"), "close")
    values = F.transform("entries", lambda e: e["val"])
    drift = "高位震盪後回落" if weekly else None
    peak = series.peak_of(values)
    return history(closes, dims.SENTIMENT_SYMBOLS, n).select(
        "symbol", F.array_join(F.transform(values, lambda v: v.cast("string")), " → ").alias("values"),
        series.trend_of(values, "持續上升", "連續回落", drift=drift).alias("trend"),
        peak["ago"].alias("peak_ago"), peak["peak"].alias("peak_val"), peak["decline_pct"].alias("decline_pct"),
    )


def simple_trends(closes: DataFrame, symbols: list[str]) -> DataFrame:
    rows = series.drop_missing(closes.filter(F.col("symbol").isin(symbols)))
    tail = series.tail_array(rows, "symbol", 3, "close")
    values = F.transform("tail", lambda e: e["close"])
    return tail.select("symbol", series.trend_of(values, "連續上升", "連續下降").alias("trend"))


def ratio_trends(closes: DataFrame, spec: dict[str, tuple[str, str]], strict_reference: bool = False) -> DataFrame:
    """(name, trend) of a/b over the last three days both have; `strict_reference` pairs by position."""
    symbols = sorted({s for two in spec.values() for s in two})
    rows = series.drop_missing(closes.filter(F.col("symbol").isin(symbols)))
    if strict_reference:
        both = series.pairs(series.back_position(rows, "symbol", 3), spec, "back").withColumn("o", -F.col("back"))
    else:
        both = series.pairs(rows, spec, "dt").withColumn("o", F.unix_date("dt"))
    newest = first_k(both, ["name"], [F.col("o").desc()], 3, out="place")
    entry = F.struct("o", ratio(F.col("a"), F.col("b")).alias("r"))
    values = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["r"])
    return newest.groupBy("name").agg(series.trend_of(values, "連續擴大", "連續收縮").alias("trend"))


def second_layer_trends(closes: DataFrame, weekly: bool = False, strict_reference: bool = False) -> DataFrame:
    """(name, trend) of the second-layer instruments and ratios."""
    if weekly:
        closes = series.weekly(series.drop_missing(closes)).select("symbol", F.col("week").alias("dt"), "close")
    names = F.create_map(*[F.lit(x) for k, s in dims.TREND_SYMBOLS.items() for x in (s, k)])
    out = simple_trends(closes, list(dims.TREND_SYMBOLS.values())).select(names[F.col("symbol")].alias("name"), "trend")
    return out.unionByName(ratio_trends(closes, dims.TREND_PAIRS, strict_reference))


# ---- macro, credit, options ------------------------------------------------

def macro_changes(macro: DataFrame) -> DataFrame:
    """Latest value, change and direction per macro series with at least two values.

    An unchanged series reads as not risen: easing for the conditions index, tightening else.
    """
    rows = macro.filter(F.col("value").isNotNull()).withColumnsRenamed({"value": "close", "series": "symbol"})
    two = series.last_two(rows).filter(F.col("previous").isNotNull())
    change = F.col("latest") - F.col("previous")
    key = F.col("symbol")
    good = F.when(key == "nfci", ~(change > 0)).when(key == "reserves", change > 0).otherwise(change < 0)
    digits = F.when(key == "nfci", 3).otherwise(0)
    return two.select(
        key.alias("series"), "data_date", rnd(F.col("latest"), 3).alias("value"), rnd(change, 3).alias("change"),
        F.when(good, "pos").otherwise("neg").alias("dir"),
        F.when(key == "nfci", num.shown(rnd(F.col("latest"), 3), "0.000")).otherwise(
            F.concat(F.lit("$"), num.shown(rnd(F.col("latest"), 0), "0"), F.lit("B"))).alias("val_str"),
        F.concat(F.when(change > 0, "▲ ").otherwise("▼ "), F.when(digits == 3, num.shown(rnd(F.abs(change), 3), "0.000"))
                 .otherwise(F.concat(num.shown(rnd(F.abs(change), 0), "0"), F.lit("B")))).alias("chg_str"),
    )


def liquidity_score(changes: DataFrame) -> DataFrame:
    """One row: score, label and the signals in fixed series order. Missing series are neutral."""
    spec = dims.literal_frame(
        changes.sparkSession, [(i, *m) for i, m in enumerate(dims.MACRO)],
        "pos int, series string, label string, up string, down string, rising_good boolean",
    )
    rows = spec.join(changes.select("series", "dir"), "series", "left")
    signal = F.when((F.col("dir") == "pos") == F.col("rising_good"), F.col("up")).otherwise(F.col("down"))
    scored = rows.agg(
        F.sum(F.when(F.col("dir") == "pos", 1).when(F.col("dir") == "neg", -1).otherwise(0)).cast("int").alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("dir").isin("pos", "neg"), F.struct("pos", signal.alias("s"))))).alias("found"),
    )
    return scored.select(
        "score",
        F.when(F.col("score") >= 2, "流動性寬鬆").when(F.col("score") <= -2, "流動性收縮").otherwise("流動性中性").alias("label"),
        F.when(F.col("score") >= 2, "pos").when(F.col("score") <= -2, "neg").otherwise("neu").alias("color"),
        F.array_join(F.transform("found", lambda x: x["s"]), ", ").alias("signals"),
    )


def conditions_trend(macro: DataFrame, name: str = "nfci") -> DataFrame:
    """Latest, previous and fourth-last value of a weekly conditions index with a 0.05 band."""
    rows = macro.filter((F.col("series") == name) & F.col("value").isNotNull())
    tail = series.tail_array(rows, "series", 4, "value")
    at = lambda i: F.try_element_at("tail", F.lit(i))
    now, prev, base = at(-1)["value"], at(-2)["value"], at(-4)["value"]
    return tail.filter(F.size("tail") >= 2).select(
        at(-1)["dt"].alias("latest_date"), rnd(now, 2).alias("latest_value"), rnd(prev, 2).alias("prev_week"),
        rnd(now - prev, 2).alias("week_change"),
        F.when(base.isNull(), num.MISSING).when(now > base + 0.05, "tightening").when(now < base - 0.05, "easing")
        .otherwise("stable").alias("trend"),
    )


def window_returns(closes: DataFrame, symbols: list[str], n: int = 5) -> DataFrame:
    """First-to-last return over the newest `n` rows of each symbol (two rows at least)."""
    rows = series.drop_missing(closes.filter(F.col("symbol").isin(symbols)))
    tail = series.tail_array(rows, "symbol", n, "close").filter(F.size("tail") >= 2)
    first, last = F.get("tail", F.lit(0))["close"], F.try_element_at("tail", F.lit(-1))["close"]
    return tail.select("symbol", first.alias("first"), last.alias("last"), pct_change(last, first).alias("ret"))


def credit_panel(closes: DataFrame) -> DataFrame:
    """One row: both returns, the ratio's change and the reliability reading."""
    two = window_returns(closes, ["HYG", "LQD"])
    leg = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    wide = two.agg(
        leg("HYG", "ret").alias("hyg"), leg("LQD", "ret").alias("lqd"),
        ratio(leg("HYG", "first"), leg("LQD", "first")).alias("r0"),
        ratio(leg("HYG", "last"), leg("LQD", "last")).alias("r1"),
    )
    change = pct_change(F.col("r1"), F.col("r0"))
    return wide.select(
        num.fmt_signed(F.col("hyg"), 2).alias("hyg_weekly_return"), num.fmt_signed(F.col("lqd"), 2).alias("lqd_weekly_return"),
        num.fmt_signed(change, 3).alias("hyg_lqd_ratio_change"),
        rules.credit_reliability(F.col("hyg"), F.col("lqd")).alias("reliability"),
    )


def nearest_expiry(chain: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the first expiry on or after `as_of` per underlying."""
    open_rows = chain.filter(F.col("expiry") >= as_of)
    nearest = open_rows.groupBy("underlying").agg(F.min("expiry").alias("expiry"))
    return open_rows.join(nearest, ["underlying", "expiry"], "left_semi")


def put_call(chain: DataFrame) -> DataFrame:
    """Put over call volume per underlying and expiry; null without call volume."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")))
    return chain.groupBy("underlying", "expiry").agg(side("put").alias("puts"), side("call").alias("calls")).select(
        "underlying", "expiry", rnd(F.when(F.col("calls") > 0, ratio(F.col("puts"), F.col("calls"))), 2).alias("pc_ratio")
    )


def options_panel(closes: DataFrame, chain: DataFrame, as_of: Column, underlying: str) -> DataFrame:
    """Spot and three-month volatility, their term structure and the nearest put/call ratio."""
    last = series.last_two(series.drop_missing(closes.filter(F.col("symbol").isin("^VIX", "^VIX9D", "^VVIX"))))
    leg = lambda s: rnd(F.max(F.when(F.col("symbol") == s, F.col("latest"))), 2)
    spot = last.agg(leg("^VIX").alias("vix_spot"), leg("^VIX9D").alias("vix_other"), leg("^VVIX").alias("vvix"))
    near = put_call(nearest_expiry(chain.filter(F.col("underlying") == underlying), as_of)).select("pc_ratio")
    both = spot.join(near.limit(1), F.lit(True), "left")  # one row each
    return both.select(
        "vix_spot", "vix_other", "vvix",
        rules.term_structure(F.col("vix_spot"), F.col("vix_other")).alias("term_structure"), "pc_ratio",
    )
