"""Relative-strength and contraction screens, rank changes, picks and their reasons."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions.numeric import combined, pct_change, rnd, rs_total, rs_trend, shown
from barline.operators import contraction, ranking, series, smoothing

MIN_RS_BARS = 63
#: What a smoothed row brings along of its session.
CARRY = ("as_of", "close", "ret_13w")
HORIZON_KEYS = list(series.HORIZONS)


# ---- relative strength -----------------------------------------------------

def bench_returns(bench: DataFrame) -> DataFrame:
    """(dt, bench_13w); the benchmark itself needs 63 closes."""
    closes = series.drop_missing(bench).withColumn("ticker", F.lit("bench"))
    return series.lookback_returns(closes).filter(F.col("n_bars") >= MIN_RS_BARS).select(
        "dt", F.col("ret_13w").alias("bench_13w")
    )


def newest_bench(bench: DataFrame) -> DataFrame:
    """bench_13w of the newest day: one row, empty where the benchmark is too short."""
    return series.last_rows(bench_returns(bench).withColumn("_k", F.lit(1)), "_k", 1).select("bench_13w")


def raw_percentiles(returns: DataFrame, by: list[str], key: str = "ticker") -> DataFrame:
    """raw_1w / raw_4w / raw_13w: share of names at or below, one decimal. Names with short
    history still count in the horizons they have."""
    return ranking.percents_at_or_below(returns, by, {f"ret_{h}": f"raw_{h}" for h in HORIZON_KEYS}, [key])


def rs_fields(df: DataFrame) -> DataFrame:
    r = [F.col(c) for c in smoothing.SMOOTH]
    return df.withColumns({"rs_trend": rs_trend(*r), "rs_total": rs_total(*r)}).withColumn(
        "rs_score", rnd(F.col("rs_total"), 1)
    )


def latest_returns(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Newest row of each series that still trades, with its horizon returns."""
    ret = series.lookback_returns(series.drop_missing(bars.select(key, "dt", "close")), key)
    return series.newest_alive(ret, key)


def rs_score(bars: DataFrame, bench: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Today's relative strength per ticker; `previous` is yesterday's snapshot, if any."""
    # The one-row benchmark comes first, so that both readings of the bars lie in one job.
    today = raw_percentiles(latest_returns(bars).crossJoin(F.broadcast(newest_bench(bench))), [])
    today = today.filter(F.col("n_bars") >= MIN_RS_BARS)
    if previous is None:
        smooth = today.withColumns({s: F.col(r) for s, r in zip(smoothing.SMOOTH, smoothing.RAW)})
    else:
        smooth = smoothing.smooth_once(today, previous)
    return rs_fields(smooth).select(
        "ticker", "dt", F.col("close").alias("price"), *smoothing.RAW, *smoothing.SMOOTH, "rs_trend", "rs_total",
        "rs_score", rnd(F.col("ret_13w"), 2).alias("return_63d"),
        rnd(F.col("ret_13w") - F.col("bench_13w"), 2).alias("vs_bench_63d"),
    )


def rs_at_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Raw percentiles of every ticker at every session of `calendar` (as_of)."""
    ret = series.lookback_returns(series.drop_missing(bars.select("ticker", "dt", "close")))
    filled = series.carry_to_sessions(ret, calendar, "ticker")
    return ranking.percents_in_place(filled, ["block", "as_of"], {f"ret_{h}": f"raw_{h}" for h in HORIZON_KEYS}).drop("block")


def session_numbers(calendar: DataFrame) -> DataFrame:
    """Sessions numbered 1..n. One row per trading day, so a single task holds it easily."""
    return calendar.select("as_of", F.row_number().over(W.orderBy("as_of")).alias("seq"))


def rs_history(
    bars: DataFrame, as_of: list[date] | None = None, min_bars: int = contraction.MIN_BARS, carry: tuple[str, ...] = CARRY,
    days: DataFrame | None = None
) -> DataFrame:
    """Smoothed relative strength over all sessions of the bars, or the newest ones in `as_of`. `days` (as_of) are the
    sessions of the bars, where they are at hand.

    A snapshot holds the names that also have a contraction score, so the chain starts at
    `min_bars` bars.

    What a session was worth fades from the states. So the newest ones are tried from the `smoothing.WINDOW` sessions
    before them, whatever the states were there; while that leaves a name undecided, the sessions are more, at last all.
    """
    calendar = session_numbers(series.sessions(bars) if days is None else days)  # the fill brings seq along
    if not as_of:
        members = rs_at_sessions(bars, calendar).filter(F.col("n_bars") >= min_bars)
        return smoothing.smooth_history(members, None, carry)
    first = calendar.filter(F.col("as_of").isin(as_of)).agg(F.min("seq")).first()[0] or 0
    width = smoothing.WINDOW
    while True:
        before = max(first - 1 - width, 0)
        members = rs_at_sessions(bars, calendar.filter(F.col("seq") > before)).filter(F.col("n_bars") >= min_bars)
        # What a session that is not asked for would carry is dead weight on its way to the fold.
        members = members.withColumns({c: F.when(F.col("as_of").isin(as_of), F.col(c)) for c in carry if c != "as_of"})
        smooth = ranking.written(smoothing.smooth_newest(members, as_of, before, carry))
        if not before or smooth.filter(~F.col("settled")).isEmpty():
            return smooth.drop("settled")
        width *= smoothing.WIDER


def advance_strength(
    bars: DataFrame, folder: str, first: int | None = None, min_bars: int = contraction.MIN_BARS, carry: tuple[str, ...] = CARRY
) -> DataFrame:
    """Smoothed strength of the sessions from number `first` on (by default all that are not yet kept in `folder`).

    The newest states kept before `first` are read, only the sessions behind them get percentiles and steps, and their
    own states are kept: a day that is appended costs one session's ranking and one folder's read, a session of long ago
    at most `smoothing.BLOCK` sessions more. Sessions are numbered over all bars, so only newer days may be added.
    """
    spark = bars.sparkSession
    calendar = session_numbers(series.sessions(bars))
    last = calendar.agg(F.max("seq")).first()[0] or 0
    newest = smoothing.states_before(spark, folder, last + 1)[0]
    first = newest + 1 if first is None else first
    seq, start = smoothing.states_before(spark, folder, first)
    members = rs_at_sessions(bars, calendar.filter(F.col("seq") > seq)).filter(F.col("n_bars") >= min_bars)
    smooth = ranking.written(smoothing.smooth_history(members, None, carry, start))
    smoothing.write_states(smooth, folder, last)
    return smooth.filter(F.col("seq") >= first)


def ma_position(bars: DataFrame) -> DataFrame:
    """Percent above the 200-bar mean, tickers with at least 200 closes."""
    tail = series.last_rows(series.drop_missing(bars.select("ticker", "dt", "close")), "ticker", 200)
    means = tail.groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg("close").alias("ma200"), F.max_by("close", "dt").alias("price")
    ).filter(F.col("n") >= 200)
    return means.select("ticker", "price", "ma200",
                        rnd(pct_change(F.col("price"), F.col("ma200")), 2).alias("vs_200ma_pct"))


# ---- ranked screens --------------------------------------------------------

def rank_rows(rows: DataFrame) -> DataFrame:
    """Rank by combined score inside each as-of day; ties by ticker."""
    return ranking.position(rows, ["as_of"], "combined_score", ["ticker"])


def with_rank_change(today: DataFrame, previous: DataFrame | None) -> DataFrame:
    """rank_change and its label against the previous snapshot (ticker, rank)."""
    if previous is None:
        return today.withColumns({
            "rank_change": F.lit(None).cast("int"), "rank_change_str": F.lit("—"),
        })
    prev = previous.select("ticker", F.col("rank").alias("_prev"))
    delta = ranking.rank_delta(F.col("_prev"), F.col("rank"))
    return today.join(prev, "ticker", "left").withColumns({
        "rank_change": delta, "rank_change_str": ranking.rank_delta_label(delta),
    }).drop("_prev")


def screen_us(rs: DataFrame, vcp: DataFrame, sectors: DataFrame) -> DataFrame:
    """Join the measures of one or more as-of days and rank. A row needs both scores.

    rs: ticker, as_of, close, ret_13w, rs_*; vcp: the contraction measures; sectors: ticker, sector.
    """
    joined = (
        rs_fields(rs).join(vcp, ["ticker", "as_of"])
        .join(sectors.select("ticker", "sector"), "ticker", "left")
    )
    rows = joined.select(
        "as_of", "ticker", F.coalesce("sector", F.lit("Other")).alias("sector"), "rs_score", "rs_trend",
        *smoothing.SMOOTH, "contraction_score", "vcp_pullback_count", "last_pullback_pct", "dist_from_high_pct",
        "rising_lows", rnd(combined(F.col("rs_score"), F.col("contraction_score")), 1).alias("combined_score"),
        rnd(F.col("close"), 2).alias("price"), rnd(F.col("ret_13w"), 2).alias("return_63d"),
        rnd(pct_change(F.col("close"), F.col("ma200")), 2).alias("vs_200ma_pct"), "atr_contraction",
        "price_range_pct", "volume_ratio",
    )
    return rank_rows(rows)


def screen_tw(rs: DataFrame, vcp: DataFrame, members: DataFrame) -> DataFrame:
    """The second market: a missing contraction score counts 50, the mean gap uses the rounded price."""
    joined = (
        rs_fields(rs).join(vcp, ["ticker", "as_of"], "left")
        .join(members.select("ticker", "name", "list"), "ticker")
    )
    score = F.coalesce("contraction_score", F.lit(50.0))
    price = rnd(F.col("close"), 1)
    rows = joined.select(
        "as_of", "ticker", "name", F.col("list").alias("etf"), "rs_score", *smoothing.SMOOTH, "rs_trend",
        score.alias("contraction_score"), rnd(combined(F.col("rs_total"), score), 1).alias("combined_score"),
        price.alias("price"), rnd(pct_change(price, F.col("ma200")), 2).alias("vs_200ma_pct"),
        "vcp_pullback_count", "last_pullback_pct", "dist_from_high_pct", "rising_lows", "volume_ratio",
    )
    return rank_rows(rows)


def latest_with_change(ranked: DataFrame, sessions_: list[date]) -> DataFrame:
    """The newest session's rows with their change since the session before.

    Both sessions go through the ranking together; a lag inside each ticker's two rows finds the
    earlier rank, so nothing is computed twice.
    """
    if len(sessions_) < 2:
        return with_rank_change(ranked.filter(F.col("as_of") == F.lit(sessions_[-1])), None)
    w = W.partitionBy("ticker").orderBy("as_of")
    before = F.when(F.lag("as_of").over(w) == F.lit(sessions_[-2]), F.lag("rank").over(w))
    today = ranked.withColumn("_prev", before).filter(F.col("as_of") == F.lit(sessions_[-1]))
    delta = ranking.rank_delta(F.col("_prev"), F.col("rank"))
    return today.withColumns({
        "rank_change": delta, "rank_change_str": ranking.rank_delta_label(delta),
    }).drop("_prev")


def newest_sessions(bars: DataFrame, n: int) -> list[date]:
    """The newest `n` trading days, oldest first: `n` values for the driver, not data."""
    days = series.sessions(bars).orderBy(F.col("as_of").desc()).limit(n).collect()
    return sorted(r["as_of"] for r in days)


# ---- group ranking ---------------------------------------------------------

def group_ranking(closes: DataFrame, names: DataFrame, bench: DataFrame, key: str = "ticker") -> DataFrame:
    """Rank a group of funds or indices against a benchmark, without smoothing.

    names: (ticker, name, pos); ties keep the listing order.
    """
    listed = closes.join(names.select(key, "name", "pos"), key)
    ret = series.lookback_returns(series.drop_missing(listed), key)
    newest = series.newest_alive(ret, key).crossJoin(F.broadcast(newest_bench(bench)))
    today = raw_percentiles(newest, [], key).filter(F.col("n_bars") >= MIN_RS_BARS)
    scored = rs_fields(today.withColumns({s: F.col(r) for s, r in zip(smoothing.SMOOTH, smoothing.RAW)}))
    gained = rnd(F.col("ret_13w"), 2)
    rows = scored.select(
        F.col(key).alias("ticker"), "name", "pos", "rs_score", *smoothing.SMOOTH, "rs_trend",
        gained.alias("return_13w"), rnd(gained - F.col("bench_13w"), 2).alias("vs_benchmark"),
        rnd(F.col("close"), 2).alias("price"),
    )
    return ranking.position(rows, [], "rs_score", ["pos"]).drop("pos")


# ---- picks -----------------------------------------------------------------

def _near(limit: float, strict_reference: bool) -> Column:
    distance = F.coalesce("dist_from_high_pct", F.lit(99.0))
    if strict_reference:  # a distance of exactly zero used to read as missing
        distance = F.when(distance == 0, 99.0).otherwise(distance)
    return distance < limit


def setup_tier(strict_reference: bool = False) -> Column:
    """1 (best) to 4, null outside all tiers."""
    rs, vcp, trend = F.col("rs_score"), F.col("contraction_score"), F.col("rs_trend")
    strong = (rs >= 80) & (vcp >= 75) & (trend == "加速上升")
    return (
        F.when(strong & _near(5, strict_reference) & (F.coalesce("volume_ratio", F.lit(1.0)) < 0.8), 1)
        .when(strong & _near(8, strict_reference), 2)
        .when((rs >= 78) & (vcp >= 70) & trend.isin("加速上升", "穩定維持"), 3)
        .when((rs >= 75) & (vcp >= 65), 4)
    )


# Pick directions in the order they choose.
DIRECTIONS = ["minervini", "momentum", "vcp"]


def top_picks(ranked: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Up to three different tickers: best setup, largest rank gain, best contraction shape.

    When a direction's first choice is taken already, the next one comes from its fallback pool:
    rank order, except the rank gain, which keeps its own order. At most two tickers can be
    taken, so three candidates per list decide everything: one pass over the ranked rows cuts
    them to a dozen.
    """
    rs, vcp, rank = F.col("rs_score"), F.col("contraction_score"), F.col("rank")
    score, gain = F.col("combined_score"), F.col("rank_change")
    tier = setup_tier(strict_reference)
    in_shape = (vcp >= 75) & (rs >= 70)
    entry = lambda name, *keys: F.struct(
        F.lit(name).alias("pool"), *[k.cast("double").alias(f"k{i}") for i, k in enumerate(keys)])
    pools = F.array_compact(F.array(
        F.when(tier.isNotNull(), entry("setup", tier, -score)),
        F.when((gain > 0) & (rs >= 65), entry("gain", -gain, F.lit(0))),
        F.when(in_shape, entry("shape", -rnd(vcp * 0.7 + rs * 0.3, 4), F.lit(0))),
        F.when(in_shape, entry("shape_by_rank", F.lit(0), F.lit(0))),
    ))
    row = F.struct(*ranked.columns).alias("row")
    entries = ranked.select(row, rank.alias("_rank"), F.explode(pools).alias("e")).select("row", "_rank", "e.*")
    best = ranking.first_k(entries, ["pool"], [F.col("k0"), F.col("k1"), F.col("_rank")], 3, out="place")
    lists = best.agg(F.sort_array(F.collect_list(F.struct("pool", "place", "row"))).alias("all"))

    def choose(pool: str, *taken: Column) -> Column:
        free = lambda c: reduce(
            lambda ok, t: ok & (c["row"]["ticker"] != F.coalesce(t["ticker"], F.lit(""))), taken, c["pool"] == pool)
        return F.get(F.filter("all", free), F.lit(0))["row"]

    chosen = (
        lists.withColumn("p0", choose("setup"))
        .withColumn("p1", choose("gain", F.col("p0")))
        .withColumn("first_shape", choose("shape"))
    )
    used = (F.col("p0"), F.col("p1"))
    is_free = reduce(lambda ok, t: ok & (F.col("first_shape.ticker") != F.coalesce(t["ticker"], F.lit(""))), used, F.lit(True))
    final = chosen.withColumn("p2", F.when(is_free, F.col("first_shape")).otherwise(choose("shape_by_rank", *used)))
    named = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"p{i}").alias("row")) for i, d in enumerate(DIRECTIONS)])
    picks = final.select(F.explode(named).alias("x")).filter("x.row IS NOT NULL").select("x.direction", "x.row.*")
    return picks.withColumn("reason", pick_reason())


def pick_reason() -> Column:
    """Up to five phrases, else the combined score."""
    rs, vcp, trend = F.col("rs_score"), F.col("contraction_score"), F.col("rs_trend")
    n, last, dist = F.col("vcp_pullback_count"), F.col("last_pullback_pct"), F.col("dist_from_high_pct")
    vol, above, gain = F.col("volume_ratio"), F.col("vs_200ma_pct"), F.col("rank_change")
    number = lambda c, pattern, digits: shown(rnd(c, digits), pattern)
    phrases = F.array_compact(F.array(
        F.when(rs >= 80, F.concat(F.lit("RS "), number(rs, "0", 0))),
        F.when(trend == "加速上升", "RS加速上升").when(trend == "穩定維持", "RS穩定維持"),
        F.when(vcp >= 75, F.concat(F.lit("VCP "), number(vcp, "0", 0))),
        F.when(n >= 2, F.concat(n.cast("string"), F.lit("次收縮"))),
        F.when(F.col("rising_lows"), "底部抬高"),
        F.when((last != 0) & (last < 8), F.concat(F.lit("末段回撤"), number(last, "0.0", 1), F.lit("%"))),
        F.when((dist != 0) & (dist < 5), F.concat(F.lit("距前高"), number(dist, "0.0", 1), F.lit("%"))),
        F.when((vol != 0) & (vol < 0.8), F.concat(F.lit("量縮"), number(vol, "0.00", 2), F.lit("x"))),
        F.when(above > 0, F.concat(F.lit("200MA+"), number(above, "0.0", 1), F.lit("%"))),
        F.when(gain > 0, F.concat(F.lit("排名↑"), gain.cast("string"))),
    ))
    fallback = F.concat(F.lit("綜合分 "), number(F.col("combined_score"), "0", 0))
    return F.when(F.size(phrases) > 0, F.array_join(F.slice(phrases, 1, 5), "、")).otherwise(fallback)


# ---- reports ---------------------------------------------------------------

def top_n(ranked: DataFrame, n: int = 30) -> DataFrame:
    return ranked.orderBy("rank").limit(n)


def rank_population(ranked: DataFrame, n: int = 5) -> DataFrame:
    """How many names were screened, and the first few of them."""
    top = F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "ticker")))  # at most n entries
    return ranked.agg(
        F.count("*").alias("screened"), F.array_join(F.transform(F.sort_array(top), lambda r: r["ticker"]), ",").alias("top5")
    )


def sector_distribution(top: DataFrame) -> DataFrame:
    """Count per sector of a top list with its bar width (longest = 200)."""
    counts = top.groupBy("sector").agg(F.count("*").alias("n"))
    widest = F.max("n").over(W.partitionBy(F.lit(1)))  # at most 30 sectors
    return counts.select("sector", "n", F.floor(F.col("n") / widest * 200).cast("int").alias("bar_width"))
