"""Registered queries: bars, returns, percentiles, scores, screens and picks."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import functions as F

from barline.catalog import sql as s
from barline.catalog.registry import day, query, yes_no
from barline.functions.numeric import pct_change, rnd
from barline.operators import contraction, ranking, series, smoothing
from barline.plans import fundamentals as fund
from barline.plans import screener as scr
from barline.session import work_folder
from barline.sources import dims, readers, sinks
from barline.sources import driver_tables as t

YN = "CASE WHEN {0} THEN 'yes' WHEN NOT {0} THEN 'no' END AS {0}"


def _bars(cols: list[str], digits: int = 4):
    return [rnd(F.col(c), digits).alias(c) for c in cols]


OHLCV = ["open", "high", "low", "close", "volume"]


@query("bars_daily", s.with_(
    f"SELECT ticker, {s.day('dt')} AS dt, " + ", ".join(f"{s.r(c, 4)} AS {c}" for c in OHLCV) + " FROM bars", "bars"))
def bars_daily(spark, sf):
    return t.bars(spark, sf).select("ticker", day("dt").alias("dt"), *_bars(OHLCV))


@query("bars_weekly", s.with_(f"""
SELECT ticker, {s.day("date_trunc('week', dt)")} AS week, {s.r('arg_min(open, dt)', 4)} AS open, {s.r('max(high)', 4)} AS high,
       {s.r('min(low)', 4)} AS low, {s.r('arg_max(close, dt)', 4)} AS close, {s.r('sum(volume)', 4)} AS volume
FROM bars GROUP BY ticker, date_trunc('week', dt)""", "bars"))
def bars_weekly(spark, sf):
    return series.weekly_bars(t.bars(spark, sf)).select("ticker", day("week").alias("week"), *_bars(OHLCV))


@query("bars_last_300", s.with_(f"""
SELECT ticker, {s.day('dt')} AS dt, {s.r('close', 4)} AS close FROM bars
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) <= 300""", "bars"))
def bars_last_300(spark, sf):
    return series.last_rows(t.bars(spark, sf), "ticker", 300).select("ticker", day("dt").alias("dt"), *_bars(["close"]))


@query("wide_panel_to_long", s.with_(f"SELECT symbol, {s.day('dt')} AS dt, close FROM closes", "instruments", "closes"))
def wide_panel_to_long(spark, sf):
    symbols = [row[2] for row in dims.instrument_rows()]
    wide = t.closes(spark, sf).groupBy("dt").pivot("symbol", symbols).agg(F.max("close"))
    renamed = wide.toDF("dt", *[f"c{i}" for i in range(len(symbols))])
    names = F.create_map(*[F.lit(x) for i, n in enumerate(symbols) for x in (f"c{i}", n)])
    long = series.to_long(renamed, "close", "col")
    return long.select(names[F.col("col")].alias("symbol"), day("dt").alias("dt"), "close")


@query("dropna_per_series", s.with_(f"""
SELECT symbol, {s.day('dt')} AS dt, close FROM closes WHERE day(dt) % 5 <> 0
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= 3""", "instruments", "closes"))
def dropna_per_series(spark, sf):
    gaps = t.closes(spark, sf).withColumn("close", F.when(F.dayofmonth("dt") % 5 != 0, F.col("close")))
    return series.last_rows(series.drop_missing(gaps), "symbol", 3).select("symbol", day("dt").alias("dt"), "close")


@query("min_history", s.with_("""
SELECT ticker, count(*) AS n_bars, count(*) >= 63 AS has_rs, count(*) >= 150 AS has_vcp, count(*) >= 200 AS has_ma
FROM bars WHERE right(ticker, 1) <> '7' OR dt >= DATE '2001-01-01' GROUP BY ticker""", "bars"))
def min_history(spark, sf):
    rows = t.bars(spark, sf).filter(~F.endswith("ticker", F.lit("7")) | (F.col("dt") >= F.lit("2001-01-01").cast("date")))
    return rows.groupBy("ticker").agg(F.count("*").alias("n_bars")).select(
        "ticker", "n_bars", (F.col("n_bars") >= scr.MIN_RS_BARS).alias("has_rs"),
        (F.col("n_bars") >= contraction.MIN_BARS).alias("has_vcp"), (F.col("n_bars") >= 200).alias("has_ma"))


RET = ["ret_1w", "ret_4w", "ret_13w"]


@query("lookback_returns", s.with_(
    f"SELECT ticker, {s.day('dt')} AS dt, n_bars, " + ", ".join(f"{s.r(c, 4)} AS {c}" for c in RET) + " FROM returns",
    "bars", "returns"))
def lookback_returns(spark, sf):
    ret = series.lookback_returns(t.bars(spark, sf).select("ticker", "dt", "close"))
    return ret.select("ticker", day("dt").alias("dt"), F.col("n_bars").cast("long").alias("n_bars"), *_bars(RET))


@query("bench_join", s.with_(f"""
SELECT ticker, {s.r('ret_13w', 2)} AS return_63d, {s.r('ret_13w - bench_13w', 2)} AS vs_bench_63d
FROM today, bench13 WHERE n_bars >= 63""", "bars", "bench", "bench13", "returns", "today"))
def bench_join(spark, sf):
    bars = t.bars(spark, sf)
    return scr.rs_score(bars, t.benchmark_closes(bars)).select("ticker", "return_63d", "vs_bench_63d")


@query("pct_rank", s.with_("SELECT ticker, raw_1w, raw_4w, raw_13w FROM raw", "bars", "returns", "today", "raw"))
def pct_rank(spark, sf):
    return scr.raw_percentiles(scr.latest_returns(t.bars(spark, sf)), []).select("ticker", *smoothing.RAW)


@query("pct_rank_history", s.with_(
    f"SELECT {s.day('as_of')} AS as_of, ticker, {s.share('ret_1w', 'as_of')} AS raw_1w, {s.share('ret_4w', 'as_of')} AS raw_4w, "
    f"{s.share('ret_13w', 'as_of')} AS raw_13w FROM grid", "bars", "returns", "cal", "grid"))
def pct_rank_history(spark, sf):
    bars = t.bars(spark, sf)
    return scr.rs_at_sessions(bars, series.sessions(bars)).select(day("as_of").alias("as_of"), "ticker", *smoothing.RAW)


@query("rs_score_raw", s.with_(f"""
SELECT ticker, {s.r(s.total('raw_1w', 'raw_4w', 'raw_13w'), 1)} AS rs_score, raw_1w AS rs_1w, raw_4w AS rs_4w, raw_13w AS rs_13w,
       {s.trend_case('raw_1w', 'raw_4w', 'raw_13w')} AS rs_trend, {s.r('ret_13w', 2)} AS return_63d,
       {s.r('ret_13w - bench_13w', 2)} AS vs_bench_63d
FROM raw, bench13 WHERE n_bars >= 63""", "bars", "bench", "bench13", "returns", "today", "raw"))
def rs_score_raw(spark, sf):
    bars = t.bars(spark, sf)
    return scr.rs_score(bars, t.benchmark_closes(bars)).select(
        "ticker", "rs_score", "rs_1w", "rs_4w", "rs_13w", "rs_trend", "return_63d", "vs_bench_63d")


@query("rs_score_with_previous", s.with_(f"""
SELECT ticker, rs_1w, rs_4w, rs_13w, {s.trend_case('rs_1w', 'rs_4w', 'rs_13w')} AS rs_trend,
       {s.r(s.total('rs_1w', 'rs_4w', 'rs_13w'), 1)} AS rs_score FROM (
  SELECT ticker, n_bars, """ + ", ".join(
    f"coalesce({s.r(f'p.prev_{h} * 0.8::DOUBLE + raw_{h} * 0.2::DOUBLE', 1)}, raw_{h}) AS rs_{h}" for h in ("1w", "4w", "13w")) + f"""
  FROM raw LEFT JOIN (SELECT 'T' || s_suppkey AS ticker, """ + ", ".join(
    f"{s.r(f'(s_suppkey * {m}) % 101 * 1.0', 1)} AS prev_{h}" for h, m in (("1w", 7), ("4w", 11), ("13w", 13))) + """
             FROM supplier WHERE s_suppkey % 4 <> 0) p USING (ticker)) WHERE n_bars >= 63""",
    "bars", "bench", "bench13", "returns", "today", "raw"))
def rs_score_with_previous(spark, sf):
    bars = t.bars(spark, sf)
    key = F.col("s_suppkey")
    previous = t.table(spark, sf, "supplier").filter(key % 4 != 0).select(
        t.ticker_of(key).alias("ticker"),
        *[rnd(((key * m) % 101) * 1.0, 1).alias(c) for c, m in zip(smoothing.SMOOTH, (7, 11, 13))])
    return scr.rs_score(bars, t.benchmark_closes(bars), previous).select("ticker", *smoothing.SMOOTH, "rs_trend", "rs_score")


@query("ema_smooth", s.with_(f"""
SELECT e.ticker, {s.day('g.as_of')} AS as_of, e.rs_1w, e.rs_4w, e.rs_13w FROM ema e JOIN graw g ON g.ticker = e.ticker AND g.k = e.k""",
                             "bars", "returns", "cal", "grid", "graw", "ema"))
def ema_smooth(spark, sf):
    return scr.rs_history(t.bars(spark, sf), carry=("as_of",)).select("ticker", day("as_of").alias("as_of"), *smoothing.SMOOTH)


@query("ema_incremental", s.with_(f"""
SELECT e.ticker, {s.day('g.as_of')} AS as_of, e.rs_1w, e.rs_4w, e.rs_13w FROM ema e JOIN graw g ON g.ticker = e.ticker AND g.k = e.k
WHERE g.as_of >= (SELECT max(as_of) FROM cal) - 2""",
                                  "bars", "returns", "cal", "grid", "graw", "ema"))
def ema_incremental(spark, sf):
    """The history up to three days before the end, and each later session as a run of its own on the states it finds."""
    bars = ranking.written(t.bars(spark, sf))
    edge = bars.agg(F.max("dt")).first()[0]
    folder = work_folder(spark, "strength")
    spark.createDataFrame([], smoothing.STATE).write.partitionBy("seq").parquet(folder)
    runs = [scr.advance_strength(bars.filter(F.col("dt") <= F.lit(edge - timedelta(days=back))), folder, carry=("as_of",)) for back in (3, 2, 1, 0)]
    new = reduce(lambda a, b: a.unionByName(b), runs[1:])
    return new.select("ticker", day("as_of").alias("as_of"), *smoothing.SMOOTH)


@query("ma_position", s.with_(f"""
SELECT ticker, {s.r(s.pct('arg_max(close, dt)', 'avg(close)'), 2)} AS vs_200ma_pct FROM (
  SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) <= 200)
GROUP BY ticker HAVING count(*) >= 200""", "bars"))
def ma_position(spark, sf):
    return scr.ma_position(t.bars(spark, sf)).select("ticker", "vs_200ma_pct")


@query("true_range_atr", s.with_(f"""
SELECT ticker, {s.r('avg(CASE WHEN rn <= 10 THEN tr END)', 4)} AS atr10, {s.r('avg(tr)', 4)} AS atr60,
       {s.r('(1 - avg(CASE WHEN rn <= 10 THEN tr END) / avg(tr)) * 100', 1)} AS atr_contraction FROM (
  SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn,
         greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt)) WHERE rn <= 60 GROUP BY ticker""", "bars"))
def true_range_atr(spark, sf):
    rows = series.true_range(t.bars(spark, sf)).withColumn("back", F.row_number().over(series.newest_first("ticker")))
    means = rows.filter(F.col("back") <= 60).groupBy("ticker").agg(
        F.avg(F.when(F.col("back") <= 10, F.col("tr"))).alias("atr10"), F.avg("tr").alias("atr60"))
    return means.select("ticker", rnd(F.col("atr10"), 4).alias("atr10"), rnd(F.col("atr60"), 4).alias("atr60"),
                        rnd((1 - F.col("atr10") / F.col("atr60")) * 100, 1).alias("atr_contraction"))


@query("price_range_volume_ratio", s.with_(f"""
SELECT ticker, {s.r('(max(CASE WHEN rn <= 10 THEN high END) - min(CASE WHEN rn <= 10 THEN low END)) / max(CASE WHEN rn = 1 THEN close END) * 100', 2)} AS price_range_pct,
       {s.r('avg(CASE WHEN rn <= 10 THEN volume END) / avg(volume)', 2)} AS volume_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn FROM bars) WHERE rn <= 60 GROUP BY ticker""", "bars"))
def price_range_volume_ratio(spark, sf):
    rows = t.bars(spark, sf).withColumn("back", F.row_number().over(series.newest_first("ticker"))).filter("back <= 60")
    ten = lambda c: F.when(F.col("back") <= 10, F.col(c))
    m = rows.groupBy("ticker").agg(
        F.max(ten("high")).alias("hi"), F.min(ten("low")).alias("lo"), F.max(F.when(F.col("back") == 1, F.col("close"))).alias("px"),
        F.avg(ten("volume")).alias("v10"), F.avg("volume").alias("v60"))
    return m.select("ticker", rnd((F.col("hi") - F.col("lo")) / F.col("px") * 100, 2).alias("price_range_pct"),
                    contraction.volume_ratio(F.col("v10"), F.col("v60")).alias("volume_ratio"))


@query("local_highs", s.with_(f"SELECT ticker, {s.day('dt')} AS dt, high FROM marked WHERE is_high", "bars", "smooth", "marked"))
def local_highs(spark, sf):
    rows = contraction.mark_local_highs(t.bars_smooth(spark, sf)).filter("is_high")
    return rows.select("ticker", day("dt").alias("dt"), "high")


VCP_COLS = ["contraction_score", "vcp_pullback_count", "last_pullback_pct", "dist_from_high_pct", "atr_contraction",
            "price_range_pct", "volume_ratio"]


@query("vcp_score", s.with_(
    f"SELECT ticker, {s.day('as_of')} AS as_of, {', '.join(VCP_COLS)}, {YN.format('rising_lows')}, {YN.format('trend_ok')} FROM vcp",
    *s.SCREEN[:2], *s.SCREEN[7:17]))
def vcp_score(spark, sf):
    bars = t.bars_smooth(spark, sf)
    out = contraction.contraction_score(bars, scr.newest_sessions(t.bars(spark, sf), 2))
    return out.select("ticker", day("as_of").alias("as_of"), *VCP_COLS, yes_no("rising_lows").alias("rising_lows"),
                      yes_no("trend_ok").alias("trend_ok"))


def _screen_inputs(spark, sf, made=None):
    bars, dates = t.bars_smooth(spark, sf, made), t.bar_days(spark, sf)
    days = scr.newest_sessions(dates, 2)
    return days, scr.rs_history(bars, days, days=series.sessions(dates)), contraction.contraction_score(bars, days)


def ranked_us(spark, sf, made=None):
    days, rs, vcp = _screen_inputs(spark, sf, made)
    return scr.latest_with_change(scr.screen_us(rs, vcp, t.universe(spark, sf)), days)


def ranked_tw(spark, sf):
    days, rs, vcp = _screen_inputs(spark, sf)
    members = readers.first_membership(t.membership(spark, sf), dims.MEMBERSHIP_LISTS)
    return scr.latest_with_change(scr.screen_tw(rs, vcp, members), days)


US_COLS = ["ticker", "sector", "rs_score", "rs_trend", "rs_1w", "rs_4w", "rs_13w", "contraction_score",
           "last_pullback_pct", "dist_from_high_pct", "combined_score", "price", "return_63d", "vs_200ma_pct",
           "atr_contraction", "price_range_pct", "volume_ratio", "rank_change_str"]


@query("screener_us", s.with_(
    f"SELECT CAST(rank AS INTEGER) AS rank, {', '.join(US_COLS)}, {YN.format('rising_lows')} FROM chg",
    *s.SCREEN, "universe", "us", s.changed("us")))
def screener_us(spark, sf):
    return ranked_us(spark, sf).select("rank", *US_COLS, yes_no("rising_lows").alias("rising_lows"))


TW_COLS = ["ticker", "name", "etf", "rs_score", "rs_1w", "rs_4w", "rs_13w", "rs_trend", "contraction_score",
           "combined_score", "price", "vs_200ma_pct", "last_pullback_pct", "dist_from_high_pct", "volume_ratio",
           "rank_change_str"]


@query("screener_tw", s.with_(
    f"SELECT CAST(rank AS INTEGER) AS rank, {', '.join(TW_COLS)}, {YN.format('rising_lows')} FROM chg",
    *s.SCREEN, "membership", "member1", "tw", s.changed("tw")))
def screener_tw(spark, sf):
    return ranked_tw(spark, sf).select("rank", *TW_COLS, yes_no("rising_lows").alias("rising_lows"))


@query("overall_rank", s.with_("""
SELECT ticker, CAST(row_number() OVER (ORDER BY combined_score DESC, ticker) AS INTEGER) AS rank FROM (
  SELECT ticker, """ + s.r("raw_13w * 0.6::DOUBLE + raw_1w * 0.4::DOUBLE", 1) + """ AS combined_score FROM raw)""",
    "bars", "returns", "today", "raw"))
def overall_rank(spark, sf):
    raw = scr.raw_percentiles(scr.latest_returns(t.bars(spark, sf)), [])
    rows = raw.select("ticker", rnd(F.col("raw_13w") * 0.6 + F.col("raw_1w") * 0.4, 1).alias("combined_score"))
    return ranking.position(rows, [], "combined_score", ["ticker"]).select("ticker", "rank")


def _pick_table(fn, spark, sf):
    return scr.top_picks(fn(spark, sf)).select("direction", "ticker", "rank", "combined_score", "reason")


def _reason_sql() -> str:
    return """array_to_string(list_filter([
      CASE WHEN rs_score >= 80 THEN 'RS ' || printf('%.0f', """ + s.r("rs_score", 0) + """) END,
      CASE WHEN rs_trend = '加速上升' THEN 'RS加速上升' WHEN rs_trend = '穩定維持' THEN 'RS穩定維持' END,
      CASE WHEN contraction_score >= 75 THEN 'VCP ' || printf('%.0f', """ + s.r("contraction_score", 0) + """) END,
      CASE WHEN vcp_pullback_count >= 2 THEN vcp_pullback_count || '次收縮' END,
      CASE WHEN rising_lows THEN '底部抬高' END,
      CASE WHEN last_pullback_pct <> 0 AND last_pullback_pct < 8 THEN '末段回撤' || printf('%.1f', last_pullback_pct) || '%' END,
      CASE WHEN dist_from_high_pct <> 0 AND dist_from_high_pct < 5 THEN '距前高' || printf('%.1f', dist_from_high_pct) || '%' END,
      CASE WHEN volume_ratio <> 0 AND volume_ratio < 0.8 THEN '量縮' || printf('%.2f', volume_ratio) || 'x' END,
      CASE WHEN vs_200ma_pct > 0 THEN '200MA+' || printf('%.1f', """ + s.r("vs_200ma_pct", 1) + """) || '%' END,
      CASE WHEN rank_change > 0 THEN '排名↑' || rank_change END], lambda x: x IS NOT NULL)[1:5], '、')"""


@query("pick_reason", s.with_(
    f"SELECT ticker, coalesce(nullif({_reason_sql()}, ''), '綜合分 ' || printf('%.0f', {s.r('combined_score', 0)})) AS reason FROM chg",
    *s.SCREEN, "universe", "us", s.changed("us")))
def pick_reason(spark, sf):
    return ranked_us(spark, sf).select("ticker", scr.pick_reason().alias("reason"))


TIER_SQL = """CASE
  WHEN rs_score >= 80 AND contraction_score >= 75 AND rs_trend = '加速上升' AND coalesce(dist_from_high_pct, 99) < 5 AND coalesce(volume_ratio, 1) < 0.8 THEN 1
  WHEN rs_score >= 80 AND contraction_score >= 75 AND rs_trend = '加速上升' AND coalesce(dist_from_high_pct, 99) < 8 THEN 2
  WHEN rs_score >= 78 AND contraction_score >= 70 AND rs_trend IN ('加速上升', '穩定維持') THEN 3
  WHEN rs_score >= 75 AND contraction_score >= 65 THEN 4 END"""


@query("pick_tiers", s.with_(f"SELECT ticker, rank, tier FROM (SELECT ticker, CAST(rank AS INTEGER) AS rank, {TIER_SQL} AS tier FROM chg) WHERE tier IS NOT NULL",
                             *s.SCREEN, "universe", "us", s.changed("us")))
def pick_tiers(spark, sf):
    rows = ranked_us(spark, sf).withColumn("tier", scr.setup_tier())
    return rows.filter(F.col("tier").isNotNull()).select("ticker", "rank", "tier")


def _picks_sql() -> str:
    reason = f"coalesce(nullif({_reason_sql()}, ''), '綜合分 ' || printf('%.0f', {s.r('combined_score', 0)}))"
    shape = s.r("contraction_score * 0.7::DOUBLE + rs_score * 0.3::DOUBLE", 4)
    return f"""
SELECT direction, ticker, CAST(rank AS INTEGER) AS rank, combined_score, {reason} AS reason FROM (
  SELECT 'minervini' AS direction, * FROM p1 UNION ALL SELECT 'momentum', * FROM p2 UNION ALL SELECT 'vcp', * FROM p3)""", [
        f"p1 AS (SELECT * FROM chg WHERE {TIER_SQL} IS NOT NULL ORDER BY {TIER_SQL}, combined_score DESC, rank LIMIT 1)",
        "p2 AS (SELECT * FROM chg WHERE rank_change > 0 AND rs_score >= 65 AND ticker NOT IN (SELECT ticker FROM p1) ORDER BY rank_change DESC, rank LIMIT 1)",
        "used AS (SELECT ticker FROM p1 UNION ALL SELECT ticker FROM p2)",
        "shaped AS (SELECT * FROM chg WHERE contraction_score >= 75 AND rs_score >= 70)",
        f"best AS (SELECT ticker FROM shaped ORDER BY {shape} DESC, rank LIMIT 1)",
        """p3 AS (SELECT * FROM shaped WHERE ticker NOT IN (SELECT ticker FROM used)
  ORDER BY CASE WHEN ticker IN (SELECT ticker FROM best) THEN 0 ELSE 1 END, rank LIMIT 1)"""]


_PICK_BODY, _PICK_CTES = _picks_sql()


@query("top_picks", s.with_(_PICK_BODY, *s.SCREEN, "universe", "us", s.changed("us"), *_PICK_CTES))
def top_picks(spark, sf):
    return _pick_table(ranked_us, spark, sf)


@query("top_picks_tw", s.with_(_PICK_BODY, *s.SCREEN, "membership", "member1", "tw", s.changed("tw"), *_PICK_CTES))
def top_picks_tw(spark, sf):
    return _pick_table(ranked_tw, spark, sf)


@query("sector_distribution", s.with_("""
SELECT sector, count(*) AS n, CAST(floor(count(*) / max(count(*)) OVER () * 200) AS INTEGER) AS bar_width
FROM (SELECT * FROM chg ORDER BY rank LIMIT 30) GROUP BY sector""", *s.SCREEN, "universe", "us", s.changed("us")))
def sector_distribution(spark, sf):
    return scr.sector_distribution(scr.top_n(ranked_us(spark, sf)))


@query("rank_population", s.with_("""
SELECT (SELECT count(*) FROM chg) AS screened, (SELECT string_agg(ticker, ',' ORDER BY rank) FROM chg WHERE rank <= 5) AS top5""",
    *s.SCREEN, "universe", "us", s.changed("us")))
def rank_population(spark, sf):
    return scr.rank_population(ranked_us(spark, sf))


@query("snapshot_columns_tw", s.with_("""
SELECT CAST(rank AS INTEGER) AS rank, ticker, name, etf, rs_score, rs_1w, rs_4w, rs_13w, rs_trend, contraction_score, combined_score, price, vs_200ma_pct
FROM chg""", *s.SCREEN, "membership", "member1", "tw", s.changed("tw")))
def snapshot_columns_tw(spark, sf):
    from barline.sources.sinks import SNAPSHOT_TW

    return ranked_tw(spark, sf).select(*SNAPSHOT_TW)


@query("result_document", s.with_("""
SELECT (SELECT string_agg(ticker, ',' ORDER BY rank) FROM chg WHERE rank <= 30) AS top30,
       (SELECT string_agg(direction || ':' || ticker, ',' ORDER BY direction) FROM (SELECT 'minervini' AS direction, ticker FROM p1
          UNION ALL SELECT 'momentum', ticker FROM p2 UNION ALL SELECT 'vcp', ticker FROM p3)) AS picks""",
    *s.SCREEN, "universe", "us", s.changed("us"), *_PICK_CTES))
def result_document(spark, sf):
    from barline.sources.sinks import result_document as document

    bars = ranking.written(t.bars(spark, sf).drop("open"))  # strength, contraction and the markets read them
    ranked = ranked_us(spark, sf, bars)
    doc = document(scr.top_n(ranked), scr.top_picks(ranked), sector_table(spark, sf), global_table(spark, sf, bars))
    joined = lambda part, f: F.array_join(F.transform(part, f), ",")
    return doc.select(joined("top30", lambda r: r["ticker"]).alias("top30"),
                      joined("top_picks", lambda r: F.concat_ws(":", r["direction"], r["ticker"])).alias("picks"))


@query("report_sheet", s.with_("""
SELECT CAST(rank AS INTEGER) AS "Rank", rank_change_str AS "Change", ticker AS "Ticker", sector AS "Sector", rs_score AS "RS Score",
       rs_trend AS "RS Trend", contraction_score AS "VCP Score", combined_score AS "Combined Score", price AS "Price",
       vs_200ma_pct AS "vs 200MA %", volume_ratio AS "Volume Ratio" FROM chg""", *s.SCREEN, "universe", "us", s.changed("us")))
def report_sheet(spark, sf):
    from barline.sources.sinks import screen_sheet

    return screen_sheet(ranked_us(spark, sf)).select(
        "Rank", "Change", "Ticker", "Sector", "RS Score", "RS Trend", "VCP Score", "Combined Score", "Price",
        "vs 200MA %", "Volume Ratio")


@query("rank_delta", s.with_("""
SELECT ticker, CAST(p.rank - t.rank AS DOUBLE) AS rank_change,
       CASE WHEN p.rank IS NULL THEN '新進' WHEN p.rank > t.rank THEN '↑' || (p.rank - t.rank)
            WHEN p.rank < t.rank THEN '↓' || (t.rank - p.rank) ELSE '—' END AS rank_change_str
FROM (SELECT ticker, row_number() OVER (ORDER BY volume DESC, ticker) AS rank FROM bars WHERE dt = (SELECT max(dt) FROM bars)) t
LEFT JOIN (SELECT ticker, row_number() OVER (ORDER BY volume DESC, ticker) AS rank FROM bars
           WHERE dt = (SELECT max(dt) FROM bars WHERE dt < (SELECT max(dt) FROM bars))) p USING (ticker)""", "bars"))
def rank_delta(spark, sf):
    bars = t.bars(spark, sf)
    prev, today = scr.newest_sessions(bars, 2)
    ranks = {d: ranking.position(bars.filter(F.col("dt") == F.lit(d)), [], "volume", ["ticker"]).select("ticker", "rank") for d in (prev, today)}
    return scr.with_rank_change(ranks[today], ranks[prev]).select(
        "ticker", F.col("rank_change").cast("double").alias("rank_change"), "rank_change_str")


@query("snapshot_days", s.with_("""
SELECT t.ticker, CAST(t.rank AS INTEGER) AS rank, CAST(p.rank AS INTEGER) AS prev_rank
FROM (SELECT ticker, row_number() OVER (ORDER BY volume DESC, ticker) AS rank FROM bars WHERE dt = (SELECT max(dt) FROM bars)) t
LEFT JOIN (SELECT ticker, row_number() OVER (ORDER BY volume DESC, ticker) AS rank FROM bars
           WHERE dt = (SELECT max(dt) FROM bars WHERE dt < (SELECT max(dt) FROM bars))) p USING (ticker)""", "bars"))
def snapshot_days(spark, sf):
    """Two days written, the newer one first in part and then again; the newest and the one before it read back."""
    bars = t.bars(spark, sf)
    days = scr.newest_sessions(bars, 2)
    rows = bars.filter(F.col("dt").isin(days)).select(F.col("dt").alias("as_of"), "ticker", "volume")
    ranked = ranking.position(rows, ["as_of"], "volume", ["ticker"])
    folder = work_folder(spark, "snapshots")
    for part in (ranked.filter((F.col("as_of") == F.lit(days[0])) | (F.col("rank") <= 3)), ranked.filter(F.col("as_of") == F.lit(days[1]))):
        sinks.write_snapshot(part, folder, ["ticker", "rank"])
    back = spark.read.schema("ticker string, rank int, as_of date").parquet(folder)
    before = readers.newest_before(back, F.lit(days[1])).select("ticker", F.col("rank").alias("prev_rank"))
    return sinks.latest_snapshot(back).join(before, "ticker", "left").select("ticker", "rank", "prev_rank")


# ---- group rankings --------------------------------------------------------

GROUP_BODY = f"""
SELECT CAST(row_number() OVER (ORDER BY rs_score DESC, pos) AS INTEGER) AS rank, ticker, name, rs_score, rs_1w, rs_4w, rs_13w, rs_trend,
       return_13w, {s.r('return_13w - bench_13w', 2)} AS vs_benchmark, price FROM (
  SELECT ticker, name, pos, raw_1w AS rs_1w, raw_4w AS rs_4w, raw_13w AS rs_13w, {s.r('close', 2)} AS price,
         {s.r('ret_13w', 2)} AS return_13w, {s.trend_case('raw_1w', 'raw_4w', 'raw_13w')} AS rs_trend,
         {s.r(s.total('raw_1w', 'raw_4w', 'raw_13w'), 1)} AS rs_score FROM raw WHERE n_bars >= 63), bench13"""
FUND_NAMES = [(k, n, i) for i, (k, n) in enumerate(dims.SECTOR_FUNDS.items())]
GROUP_RET = f"""returns AS (
  SELECT ticker, name, pos, dt, close, {s.pct('close', 'lag(close, 4) OVER w')} AS ret_1w, {s.pct('close', 'lag(close, 20) OVER w')} AS ret_4w,
         {s.pct('close', 'lag(close, 62) OVER w')} AS ret_13w, row_number() OVER w AS n_bars
  FROM series WINDOW w AS (PARTITION BY ticker ORDER BY dt))"""
SECTOR_CTES = ["instruments", "closes", s.values("names", "ticker, name, pos", FUND_NAMES),
               "series AS (SELECT symbol AS ticker, dt, close, name, pos FROM closes JOIN names ON symbol = ticker)",
               f"bench AS (SELECT dt, close FROM closes WHERE symbol = '{dims.SECTOR_BENCHMARK}')", "bench13", GROUP_RET, "today", "raw"]
GROUP_COLS = ["rank", "ticker", "name", "rs_score", "rs_1w", "rs_4w", "rs_13w", "rs_trend", "return_13w", "vs_benchmark", "price"]


def sector_table(spark, sf):
    closes = t.closes(spark, sf)
    names = dims.literal_frame(spark, FUND_NAMES, "symbol string, name string, pos int")
    bench = closes.filter(F.col("symbol") == dims.SECTOR_BENCHMARK).select("dt", "close")
    return scr.group_ranking(closes, names, bench, "symbol")


@query("sector_ranking", s.with_(GROUP_BODY, *SECTOR_CTES))
def sector_ranking(spark, sf):
    return sector_table(spark, sf).select(*GROUP_COLS)


@query("group_ranking", s.with_(GROUP_BODY, "bars", "bench", "bench13",
                                "series AS (SELECT ticker, dt, close, s_name AS name, s_suppkey AS pos FROM bars JOIN supplier ON ticker = 'T' || s_suppkey)",
                                GROUP_RET, "today", "raw"))
def group_ranking(spark, sf):
    bars = t.bars(spark, sf)
    names = t.table(spark, sf, "supplier").select(
        t.ticker_of(F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos"))
    return scr.group_ranking(bars.select("ticker", "dt", "close"), names, t.benchmark_closes(bars)).select(*GROUP_COLS)


MARKETS = [(i, symbol, market) for i, (symbol, market) in enumerate(dims.GLOBAL_INDICES.items())]
GLOBAL_CTES = ["bars", "bench", "bench13", s.values("markets", "pos, ticker, name", MARKETS),
               f"""series AS (
  SELECT m.ticker, m.name, m.pos, dt, {s.r('avg(close)', 4)} AS close FROM bars
  JOIN supplier ON bars.ticker = 'T' || s_suppkey JOIN markets m ON m.pos = s_nationkey GROUP BY 1, 2, 3, 4)""",
               GROUP_RET, "today", "raw"]


def global_table(spark, sf, made=None):
    bars = t.bars(spark, sf) if made is None else made
    markets = dims.literal_frame(spark, MARKETS, "pos int, symbol string, name string")
    home = t.table(spark, sf, "supplier").select(t.ticker_of(F.col("s_suppkey")).alias("ticker"), F.col("s_nationkey").alias("pos"))
    # Bars without a home stay, under a place that no market has: so these are the bars that the benchmark takes, which
    # are moved once for both.
    placed = bars.join(home, "ticker", "left").select(F.coalesce("pos", F.lit(-1)).alias("pos"), "dt", "close")
    index = placed.groupBy("pos", "dt").agg(rnd(F.avg("close"), 4).alias("close"))
    closes = index.join(markets, "pos").select("symbol", "dt", "close")
    return scr.group_ranking(closes, markets, t.benchmark_closes(bars), "symbol")


@query("global_ranking", s.with_(
    f"SELECT g.*, coalesce(d.region, '{dims.OTHER_REGION}') AS region FROM ({GROUP_BODY}) g LEFT JOIN regions d ON d.market = g.name",
    *GLOBAL_CTES, s.values("regions", "region, market", [(a, m) for a, ms in dims.REGIONS.items() for m in ms])))
def global_ranking(spark, sf):
    return readers.with_region(global_table(spark, sf)).select(*GROUP_COLS, "region")


@query("region_listing", s.with_(
    f"SELECT d.region, d.region_pos, d.market_pos, g.name, g.rs_score FROM regions d JOIN ({GROUP_BODY}) g ON d.market = g.name",
    *GLOBAL_CTES, s.values("regions", "region, market, region_pos, market_pos",
                           [(a, m, i, j) for i, (a, ms) in enumerate(dims.REGIONS.items()) for j, m in enumerate(ms)])))
def region_listing(spark, sf):
    listing = dims.region_dim(spark).join(global_table(spark, sf).withColumnRenamed("name", "market"), "market")
    return listing.select("region", "region_pos", "market_pos", F.col("market").alias("name"), "rs_score")


# ---- fundamentals ----------------------------------------------------------

FUND_CTE = f"""info AS (
  SELECT 'T' || c_custkey AS ticker, {s.r('c_acctbal / 1000', 4)} AS trailing_eps, {s.r('c_acctbal / 900', 4)} AS forward_eps,
    CASE WHEN c_custkey % 7 <> 0 THEN {s.r('(c_acctbal + c_custkey % 500) / 950', 4)} END AS eps_next_yr,
    CASE WHEN c_custkey % 11 <> 0 THEN {s.r('c_acctbal * 3', 4)} END AS free_cashflow,
    {s.r('abs(c_acctbal) * 10 + c_custkey % 50', 4)} AS total_revenue,
    CASE WHEN c_custkey % 5 <> 0 THEN {s.r('c_acctbal / 40000', 4)} END AS roe,
    CASE WHEN c_custkey % 25 <> 0 THEN {s.r('c_acctbal / 80000', 4)} END AS roa,
    {s.r('c_acctbal / 30000', 4)} AS op_margin, {s.r('c_acctbal / 15000', 4)} AS gross_margin,
    CASE WHEN c_custkey % 13 <> 0 THEN {s.r('c_acctbal / 50000 - 0.05::DOUBLE', 4)} END AS rev_growth,
    {s.r('abs(c_acctbal) / 300', 4)} AS pe, CASE WHEN c_custkey % 4 <> 0 THEN {s.r('abs(c_acctbal) / 3000', 4)} END AS div_yield,
    {s.r('0.5::DOUBLE + (c_custkey % 12) / 10.0::DOUBLE', 4)} AS beta, (c_custkey % 60) * 1.0::DOUBLE AS market_cap_b
  FROM customer)"""
LINES_CTE = f"""lines AS (
  SELECT 'T' || o_custkey AS ticker,
    last(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS op_income,
    last(o_totalprice ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS invested,
    last({s.r('(o_totalprice % 40) / 100', 4)} ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS tax
  FROM orders GROUP BY o_custkey)"""
FACTS_CTE = f"""facts AS (
  SELECT ticker, {s.r('trailing_eps', 2)} AS eps_ttm, {s.r('forward_eps', 2)} AS eps_fwd, {s.r('eps_next_yr', 2)} AS eps_next_yr,
    {s.r(f"CASE WHEN trailing_eps > 0 AND {s.r('eps_next_yr', 2)} > 0 THEN (sqrt({s.r('eps_next_yr', 2)} / trailing_eps) - 1) * 100 END", 1)} AS eps_cagr_2y,
    {s.r('CASE WHEN total_revenue > 0 AND free_cashflow <> 0 THEN free_cashflow / total_revenue * 100 END', 1)} AS fcf_margin,
    {s.r('coalesce(roic0, roe * 100, roa * 100)', 1)} AS roic,
    CASE WHEN roic0 IS NOT NULL THEN 'ROIC' WHEN roe IS NOT NULL THEN 'ROE' WHEN roa IS NOT NULL THEN 'ROA' END AS roic_source,
    {s.r('op_margin * 100', 1)} AS op_margin, {s.r('gross_margin * 100', 1)} AS gross_margin, {s.r('rev_growth * 100', 1)} AS rev_growth
  FROM (SELECT i.*, CASE WHEN invested > 0 THEN op_income * (1 - coalesce(tax, 0.21::DOUBLE)) / invested * 100 END AS roic0
        FROM info i LEFT JOIN lines USING (ticker)))"""


@query("fundamentals_metrics", s.with_("SELECT * FROM facts", FUND_CTE, LINES_CTE, FACTS_CTE))
def fundamentals_metrics(spark, sf):
    return fund.metrics(t.fundamentals(spark, sf), t.statements(spark, sf))


@query("statement_latest", s.with_("SELECT * FROM lines", LINES_CTE))
def statement_latest(spark, sf):
    return fund.latest_lines(t.statements(spark, sf))


@query("fund_metrics", s.with_(f"""
SELECT ticker, {s.r('nullif(pe, 0)', 1)} AS pe, {s.r('nullif(div_yield, 0)', 2)} AS div_yield, {s.r('nullif(beta, 0)', 2)} AS beta FROM info""", FUND_CTE))
def fund_metrics(spark, sf):
    return fund.fund_metrics(t.fundamentals(spark, sf))


@query("materiality_filter", s.with_("""
SELECT ticker, market_cap_b FROM info WHERE market_cap_b >= 40
   OR (market_cap_b >= 10 AND coalesce(abs((forward_eps - eps_next_yr) / nullif(forward_eps, 0) * 100) >= 20, false))""", FUND_CTE))
def materiality_filter(spark, sf):
    return fund.material_releases(t.fundamentals(spark, sf)).select("ticker", "market_cap_b")


@query("top30_enriched", s.with_("""
SELECT CAST(rank AS INTEGER) AS rank, ticker, combined_score, eps_ttm, eps_cagr_2y, fcf_margin, roic, roic_source
FROM (SELECT * FROM chg ORDER BY rank LIMIT 30) LEFT JOIN facts USING (ticker)""",
    *s.SCREEN, "universe", "us", s.changed("us"), FUND_CTE, LINES_CTE, FACTS_CTE))
def top30_enriched(spark, sf):
    facts = fund.metrics(t.fundamentals(spark, sf), t.statements(spark, sf))
    return fund.enrich(scr.top_n(ranked_us(spark, sf)), facts).select(
        "rank", "ticker", "combined_score", "eps_ttm", "eps_cagr_2y", "fcf_margin", "roic", "roic_source")


@query("score_bands", s.with_("""
SELECT ticker, CASE WHEN roic >= 15 THEN 'strong' WHEN roic >= 5 THEN 'fair' WHEN roic < 5 THEN 'weak' END AS roic_band,
  CASE WHEN fcf_margin >= 15 THEN 'strong' WHEN fcf_margin >= 5 THEN 'fair' WHEN fcf_margin < 5 THEN 'weak' END AS fcf_us,
  CASE WHEN fcf_margin >= 10 THEN 'strong' WHEN fcf_margin >= 5 THEN 'fair' WHEN fcf_margin < 5 THEN 'weak' END AS fcf_tw,
  CASE WHEN beta > 1.2 THEN 'high' WHEN beta < 0.8 THEN 'low' WHEN beta IS NOT NULL THEN 'mid' END AS beta_band,
  CASE WHEN roic > 20 THEN 'deep_green' WHEN roic >= 10 THEN 'green' WHEN roic < 0 THEN 'red' END AS sheet_band,
  CASE WHEN rs >= 80 THEN 'strong' WHEN rs >= 60 THEN 'fair' WHEN rs < 60 THEN 'weak' END AS rs_band
FROM (SELECT f.*, i.beta, i.beta * 60 AS rs FROM facts f JOIN info i USING (ticker))""", FUND_CTE, LINES_CTE, FACTS_CTE))
def score_bands(spark, sf):
    from barline.functions import rules

    info = t.fundamentals(spark, sf)
    rows = fund.metrics(info, t.statements(spark, sf)).join(info.select("ticker", "beta"), "ticker")
    return rows.select(
        "ticker", rules.quality_band(F.col("roic")).alias("roic_band"), rules.cash_band(F.col("fcf_margin"), "us").alias("fcf_us"),
        rules.cash_band(F.col("fcf_margin"), "tw").alias("fcf_tw"), rules.beta_band(F.col("beta")).alias("beta_band"),
        rules.sheet_band(F.col("roic")).alias("sheet_band"), rules.rs_band(F.col("beta") * 60).alias("rs_band"))
