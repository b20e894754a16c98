"""Price-contraction score: pullbacks between local highs, trend, range and volume measures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions.numeric import clamp, points, ratio, rnd
from barline.operators.series import by_day, true_range

LOOKBACK = 90
MIN_BARS = 150
TREND_BARS = 200
MIN_GAP = 10
MIN_DEPTH = 3.0


def mark_local_highs(bars: DataFrame) -> DataFrame:
    """is_high: the high is the maximum of ten bars before to five after, all of them present.

    The test never looks past bar i+5, so it holds for every as-of day at least five bars later.
    """
    w = by_day("ticker")
    around = w.rowsBetween(-10, 5)
    return bars.withColumn(
        "is_high", (F.col("high") == F.max("high").over(around)) & (F.count("high").over(around) == 16)
    )


def near_sessions(bars: DataFrame, as_of: list[date], keep: int) -> DataFrame:
    """Bars that any as-of day can reach, with `n_bars` (place in the series) and `ends`, the
    number of bars each as-of day sees."""
    whole = W.partitionBy("ticker")
    ends = F.array(*[F.count(F.when(F.col("dt") <= F.lit(d), 1)).over(whole).cast("int") for d in as_of])
    numbered = bars.withColumns({"n_bars": F.row_number().over(by_day("ticker")), "ends": ends})
    return numbered.filter((F.col("n_bars") > F.array_min("ends") - keep) & (F.col("n_bars") <= F.array_max("ends")))


def at_sessions(near: DataFrame, as_of: list[date], keep: int = TREND_BARS) -> DataFrame:
    """Each (ticker, as-of) with its newest `keep` bars, `back` counting from 1 = newest. The
    expansion happens inside each ticker's partition, so it needs no further shuffle."""
    days = F.array(*[F.lit(d) for d in as_of])
    places = F.arrays_zip(days.alias("as_of"), F.col("ends").alias("n"))
    seen = F.filter(places, lambda p: (p["n"] >= F.col("n_bars")) & (p["n"] - F.col("n_bars") < keep))
    rows = near.withColumn("p", F.explode(seen))
    return rows.withColumns({"as_of": F.col("p.as_of"), "total": F.col("p.n"), "back": F.col("p.n") - F.col("n_bars") + 1}).drop("p", "ends")


def merge_close_highs(highs: Column) -> Column:
    """Fold an ordered array<struct<i,v>>: highs nearer than ten bars to the last kept one merge
    into the higher, taking its position."""

    def fold(kept: Column, high: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = F.coalesce(high["i"] - last["i"] < MIN_GAP, F.lit(False))
        replaced = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(high))
        return F.when(near & (high["v"] > last["v"]), replaced).when(near, kept).otherwise(
            F.concat(kept, F.array(high))
        )

    return F.aggregate(highs, F.array().cast("array<struct<i:int,v:double>>"), fold)


def pullbacks_between(highs: Column, bars: Column) -> Column:
    """Pullbacks of at least 3 % between consecutive highs: array<struct<depth,low,vol>>.

    `bars` is the ordered window, array<struct<i,low,volume>> with i counting from 0.
    """

    def leg(n: Column) -> Column:
        here, nxt = F.get(highs, n), F.get(highs, n + 1)
        segment = F.slice(bars, here["i"] + 1, nxt["i"] - here["i"])
        low = F.array_min(F.transform(segment, lambda b: b["low"]))
        span = F.array_position(F.transform(segment, lambda b: b["low"]), low).cast("int")
        volumes = F.slice(F.transform(segment, lambda b: b["volume"]), 1, span)
        total = F.aggregate(volumes, F.lit(0.0), lambda a, v: a + v)
        return F.struct(
            (ratio(here["v"] - low, here["v"]) * 100).alias("depth"), low.alias("low"), (total / span).alias("vol")
        )

    steps = F.when(F.size(highs) >= 2, F.transform(F.sequence(F.lit(0), F.size(highs) - 2), leg))
    legs = F.coalesce(steps, F.array().cast("array<struct<depth:double,low:double,vol:double>>"))
    return F.filter(legs, lambda p: p["depth"] >= MIN_DEPTH)


def monotone(values: Column, rising: bool) -> Column:
    """Every neighbour pair strictly rises (or falls)."""
    later = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    earlier = F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))
    ordered = F.zip_with(earlier, later, lambda a, b: (b > a) if rising else (b < a))
    return F.forall(ordered, lambda x: x)


def bar_measures(rows: DataFrame) -> DataFrame:
    """Per (ticker, as_of): price, means, ATR, range and volume measures plus the 90-bar window."""
    back = F.col("back")
    mean = lambda c, n: F.avg(F.when(back <= n, F.col(c)))
    window = F.sort_array(F.collect_list(F.when(back <= LOOKBACK, F.struct((-back).alias("o"), "low", "volume"))))
    high_points = F.sort_array(F.collect_list(F.when(
        F.col("is_high") & (back <= LOOKBACK - 10) & (back >= 6), F.struct((-back).alias("o"), F.col("high").alias("v"))
    )))
    return rows.groupBy("ticker", "as_of").agg(
        F.max("total").alias("n_bars"),
        F.max(F.when(back == 1, F.col("close"))).alias("price"),
        mean("close", 150).alias("ma150"), mean("close", TREND_BARS).alias("ma200"),
        mean("tr", 10).alias("atr10"), mean("tr", 60).alias("atr60"),
        mean("volume", 10).alias("vol10"), mean("volume", 60).alias("vol60"),
        F.max(F.when(back <= 10, F.col("high"))).alias("high10"),
        F.min(F.when(back <= 10, F.col("low"))).alias("low10"),
        window.alias("window"), high_points.alias("high_points"),
    )


def contraction_score(bars: DataFrame, as_of: list[date], min_bars: int = MIN_BARS) -> DataFrame:
    """Score and measures of every ticker with enough bars at each as-of day, with the 200-bar
    mean (null below 200 bars) so that a screen needs no second pass over the bars."""
    near = near_sessions(bars, as_of, TREND_BARS + 16)  # room for the high test and the previous close
    rows = at_sessions(true_range(mark_local_highs(near)), as_of)
    base = bar_measures(rows).filter(F.col("n_bars") >= min_bars)

    size = F.size("window")
    ordered = base.select(
        "*",
        F.transform("high_points", lambda h: F.struct((size + h["o"]).alias("i"), h["v"].alias("v"))).alias("marks"),
    ).withColumn("highs", merge_close_highs(F.col("marks")))
    legs = ordered.withColumn("pullbacks", pullbacks_between(F.col("highs"), F.col("window")))

    n = F.size("pullbacks")
    field = lambda name: F.transform("pullbacks", lambda p: p[name])
    last_depth = F.try_element_at("pullbacks", F.lit(-1))["depth"]
    last_high = F.try_element_at("highs", F.lit(-1))["v"]
    measured = legs.select(
        "ticker", "as_of", "n_bars", "price", "ma200", "high10", "low10", "vol10", "vol60",
        n.alias("pullback_count"),
        ((F.col("price") > F.col("ma150")) & (F.col("ma150") > F.col("ma200"))).alias("trend_ok"),
        F.when(n >= 2, monotone(field("depth"), rising=False)).alias("falling_depths"),
        F.when(n >= 2, monotone(field("low"), rising=True)).alias("rising_lows"),
        F.when(n >= 2, monotone(field("vol"), rising=False)).alias("falling_volumes"),
        last_depth.alias("last_depth"),
        (ratio(last_high - F.col("price"), last_high) * 100).alias("distance"),
        F.when(F.col("atr60") > 0, F.col("atr10") / F.nullif("atr60", F.lit(0.0))).otherwise(1.0).alias("atr_ratio"),
    )
    return measured.select(
        "ticker", "as_of",
        rnd(clamp(score_of(), 0.0, 100.0), 1).alias("contraction_score"),
        F.col("pullback_count").alias("vcp_pullback_count"),
        rnd(F.col("last_depth"), 1).alias("last_pullback_pct"),
        rnd(F.col("distance"), 1).alias("dist_from_high_pct"),
        "rising_lows", "trend_ok",
        rnd((1 - F.col("atr_ratio")) * 100, 1).alias("atr_contraction"),
        rnd(ratio(F.col("high10") - F.col("low10"), F.col("price")) * 100, 2).alias("price_range_pct"),
        volume_ratio(F.col("vol10"), F.col("vol60")).alias("volume_ratio"),
        F.when(F.col("n_bars") >= TREND_BARS, F.col("ma200")).alias("ma200"),
    )


def volume_ratio(short: Column, long: Column) -> Column:
    return F.when(long > 0, rnd(short / F.nullif(long, F.lit(0.0)), 2)).otherwise(1.0)


def score_of() -> Column:
    """The point table of the contraction score."""
    n, depth, distance, atr = (F.col(c) for c in ("pullback_count", "last_depth", "distance", "atr_ratio"))
    return points(
        (F.col("trend_ok"), 20),
        (n.between(2, 4), 20), (n == 1, 8), (n > 4, 10),
        (F.col("falling_depths"), 15), (F.col("rising_lows"), 15), (F.col("falling_volumes"), 10),
        (depth < 4, 15), ((depth >= 4) & (depth < 6), 10), ((depth >= 6) & (depth < 10), 5),
        (distance < 3, 15), ((distance >= 3) & (distance < 5), 10), ((distance >= 5) & (distance < 10), 5),
        (distance >= 10, -5),
        (atr < 0.5, 10), ((atr >= 0.5) & (atr < 0.7), 5),
    )
