"""Registered queries: instrument series, dashboards, macro, credit, options and rule bands."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.catalog import sql as s
from barline.catalog.registry import day, query
from barline.functions import dates, rules
from barline.functions import numeric as num
from barline.functions.numeric import pct_change, rnd
from barline.operators import series
from barline.plans import dashboard as dash
from barline.sources import dims, readers
from barline.sources import driver_tables as t

BASE = ["instruments", "closes"]
ITEM_COLS = ["category", "pos", "key", "label", "value", "change", "unit", "dir", "is_dynamic", "val_str", "chg_str"]


@query("closes_scan", s.with_(f"SELECT symbol, {s.day('dt')} AS dt, close FROM closes", *BASE))
def closes_scan(spark, sf):
    return readers.scan_closes(t.closes(spark, sf), t.instruments(spark)).select("symbol", day("dt").alias("dt"), "close")


@query("weekly_closes_scan", s.with_(f"SELECT symbol, {s.day('dt')} AS week, close FROM weekly", *BASE, "weekly"))
def weekly_closes_scan(spark, sf):
    return series.weekly(t.closes(spark, sf)).select("symbol", day("week").alias("week"), "close")


@query("weekday_filter", s.with_(f"SELECT symbol, {s.day('dt')} AS dt FROM closes WHERE isodow(dt) <= 5", *BASE))
def weekday_filter(spark, sf):
    return t.closes(spark, sf).filter(dates.is_weekday(F.col("dt"))).select("symbol", day("dt").alias("dt"))


@query("distinct_symbols", "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS symbol FROM part UNION SELECT DISTINCT l_returnflag FROM lineitem")
def distinct_symbols(spark, sf):
    part = t.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("symbol"))
    return readers.symbol_union(part, t.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol")))


@query("last_two_change", s.with_(f"""
SELECT symbol, {s.day('data_date')} AS data_date, new AS latest, old AS previous, {s.r(s.pct('new', 'old'), 4)} AS change_pct,
       {s.r('(new - old) * 100', 4)} AS change_bps FROM points""", *BASE, s.points()))
def last_two_change(spark, sf):
    p = dash.daily_points(t.closes(spark, sf))
    return p.select("symbol", day("data_date").alias("data_date"), F.col("new").alias("latest"), F.col("old").alias("previous"),
                    rnd(pct_change(F.col("new"), F.col("old")), 4).alias("change_pct"),
                    rnd(num.bps_change(F.col("new"), F.col("old")), 4).alias("change_bps"))


@query("scalar_guard", s.with_(f"""
SELECT symbol, {s.day('dt')} AS dt, {s.r(s.pct('z', 'lag(z) OVER (PARTITION BY symbol ORDER BY dt)'), 4)} AS change_pct
FROM (SELECT symbol, dt, CASE WHEN day(dt) % 6 = 0 THEN 0 ELSE close END AS z FROM closes)""", *BASE))
def scalar_guard(spark, sf):
    z = t.closes(spark, sf).withColumn("z", F.when(F.dayofmonth("dt") % 6 == 0, 0.0).otherwise(F.col("close")))
    prev = F.lag("z").over(series.by_day("symbol"))
    return z.select("symbol", day("dt").alias("dt"), rnd(pct_change(F.col("z"), prev), 4).alias("change_pct"))


@query("ratio_and_spread_items", s.with_(
    f"SELECT key, label, {s.r('value', 4)} AS value, {s.r('change', 4)} AS change, unit, dir, val_str, chg_str FROM pair_items",
    *BASE, s.points(), s.PAIR_ITEMS))
def ratio_and_spread_items(spark, sf):
    items = dash.pair_items(dash.daily_points(t.closes(spark, sf)))
    return items.select("key", "label", rnd(F.col("value"), 4).alias("value"), rnd(F.col("change"), 4).alias("change"),
                        "unit", "dir", "val_str", "chg_str")


PAIR_ON_DAY = """both_days AS (
  SELECT p.key, p.kind, a.dt, CASE WHEN p.kind = 'ratio' THEN a.close / b.close ELSE a.close - b.close END AS v
  FROM pairs p JOIN closes a ON a.symbol = p.lhs JOIN closes b ON b.symbol = p.rhs AND b.dt = a.dt)"""


@query("ratio_pair_history", s.with_(
    f"SELECT key, {s.day('dt')} AS dt, {s.r('v', 6)} AS value, {s.r('v - lag(v) OVER (PARTITION BY key ORDER BY dt)', 6)} AS change FROM both_days",
    *BASE, s.values("pairs", "key, category, kind, lhs, rhs, label, pos", dims.PAIRS), PAIR_ON_DAY))
def ratio_pair_history(spark, sf):
    kinds = F.create_map(*[F.lit(x) for key, _, kind, *_ in dims.PAIRS for x in (key, kind)])
    both = series.pairs(t.closes(spark, sf), {p[0]: (p[3], p[4]) for p in dims.PAIRS}, "dt")
    v = F.when(kinds[F.col("name")] == "ratio", F.col("a") / F.col("b")).otherwise(F.col("a") - F.col("b"))
    prev = F.lag("v").over(W.partitionBy("name").orderBy("dt"))
    return both.withColumn("v", v).select(F.col("name").alias("key"), day("dt").alias("dt"), rnd(F.col("v"), 6).alias("value"),
                                          rnd(F.col("v") - prev, 6).alias("change"))


@query("pool_top_abs", s.with_(
    f"SELECT pool, CAST(place AS INTEGER) AS place, symbol, label, {s.r('change', 4)} AS change, val_str, chg_str FROM picks",
    *BASE, s.points(), s.READINGS, s.PICKS))
def pool_top_abs(spark, sf):
    picks = dash.pool_picks(dash.item_readings(dash.daily_points(t.closes(spark, sf)), dims.instruments(spark)))
    return picks.select("pool", "place", "symbol", "label", rnd(F.col("change"), 4).alias("change"), "val_str", "chg_str")


@query("market_dashboard_daily", s.with_("SELECT * FROM items", *BASE, s.points(), s.READINGS, s.PICKS, s.PAIR_ITEMS, s.ITEMS))
def market_dashboard_daily(spark, sf):
    return dash.market_daily(t.closes(spark, sf), dims.instruments(spark)).select(*ITEM_COLS)


@query("market_dashboard_weekly", s.with_("SELECT * FROM items", *BASE, s.points(True), s.READINGS, s.PICKS, s.PAIR_ITEMS, s.ITEMS))
def market_dashboard_weekly(spark, sf):
    return dash.market_weekly(t.closes(spark, sf), dims.instruments(spark)).select(*ITEM_COLS)


@query("dynamic_split", s.with_(
    "SELECT category, count(*) FILTER (WHERE is_dynamic) AS n_dynamic, count(*) FILTER (WHERE NOT is_dynamic) AS n_fixed FROM items GROUP BY category",
    *BASE, s.points(), s.READINGS, s.PICKS, s.PAIR_ITEMS, s.ITEMS))
def dynamic_split(spark, sf):
    return dash.market_daily(t.closes(spark, sf), dims.instruments(spark)).groupBy("category").agg(
        F.count_if("is_dynamic").alias("n_dynamic"), F.count_if(~F.col("is_dynamic")).alias("n_fixed"))


@query("data_date", s.with_(f"""
SELECT {s.day('(SELECT data_date FROM points JOIN instruments USING (symbol) WHERE symbol_no = 0)')} AS data_date,
       {s.day('(SELECT max(data_date) FROM points JOIN instruments USING (symbol) WHERE pool IS NULL)')} AS newest,
       (SELECT data_date FROM points JOIN instruments USING (symbol) WHERE symbol_no = 0) < DATE '2001-11-05' AS is_stale""", *BASE, s.points()))
def data_date(spark, sf):
    found = dash.data_date(dash.daily_points(t.closes(spark, sf)), dims.instruments(spark))
    return found.select(day("data_date").alias("data_date"), day("newest").alias("newest"),
                        rules.is_stale_data(F.col("data_date"), F.lit("2001-11-05").cast("date")).alias("is_stale"))


@query("week_first_last", s.with_("SELECT symbol, old AS first, new AS last FROM points", *BASE, s.points(True)))
def week_first_last(spark, sf):
    return series.week_first_last(t.closes(spark, sf)).select("symbol", "first", "last")


SENT = ", ".join(s.lit(x) for x in dims.SENTIMENT_SYMBOLS)


def _history(n: int, source: str) -> str:
    return f"""hist AS (
  SELECT symbol, list({s.r('close', 2)} ORDER BY dt) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM {source} WHERE symbol IN ({SENT}))
  WHERE rn <= {n} GROUP BY symbol HAVING count(*) >= 2)"""


def _history_body(drift: str | None = None) -> str:
    return f"""
SELECT symbol, array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ' → ') AS "values", {s.three('v', '持續上升', '連續回落', drift)} AS trend,
       CAST(len(v) - list_position(v, list_max(v)) AS INTEGER) AS peak_ago, list_max(v) AS peak_val,
       {s.r('(list_max(v) - v[-1]) / list_max(v) * 100', 1)} AS decline_pct FROM hist"""


@query("sentiment_history_daily", s.with_(_history_body(), *BASE, _history(5, "closes")))
def sentiment_history_daily(spark, sf):
    return dash.sentiment_history(t.closes(spark, sf), 5)


@query("sentiment_history_weekly", s.with_(_history_body("高位震盪後回落"), *BASE, "weekly", _history(8, "weekly")))
def sentiment_history_weekly(spark, sf):
    return dash.sentiment_history(t.closes(spark, sf), 8, weekly=True)


@query("history_last_n", s.with_(f"""
SELECT symbol, {s.day('dt')} AS dt, array_to_string(list_transform(list(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
       lambda x: printf('%.2f', {s.r('x', 2)})), ',') AS last5 FROM closes""", *BASE))
def history_last_n(spark, sf):
    window = series.by_day("symbol").rowsBetween(-4, 0)
    shown = F.transform(F.collect_list("close").over(window), lambda v: num.shown(rnd(v, 2), "0.00"))
    return t.closes(spark, sf).select("symbol", day("dt").alias("dt"), F.array_join(shown, ",").alias("last5"))


TREND_NAMES = s.values("names", "name, symbol", list(dims.TREND_SYMBOLS.items()))


def _trend_sql(source: str) -> str:
    simple = s.three("v", "連續上升", "連續下降")
    wide = s.three("v", "連續擴大", "連續收縮")
    ratios = " UNION ALL ".join(f"""SELECT '{n}', {wide} FROM (SELECT list(q ORDER BY dt) AS v FROM (
      SELECT a.dt, a.close / b.close AS q FROM {source} a JOIN {source} b ON a.dt = b.dt WHERE a.symbol = '{left}' AND b.symbol = '{right}' ORDER BY a.dt DESC LIMIT 3))"""
                                for n, (left, right) in dims.TREND_PAIRS.items())
    return f"""SELECT name, {simple} AS trend FROM (
      SELECT symbol, list(close ORDER BY dt) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM {source})
      WHERE rn <= 3 GROUP BY symbol) JOIN names USING (symbol) UNION ALL {ratios}"""


@query("second_layer_trends", s.with_(_trend_sql("closes"), *BASE, TREND_NAMES))
def second_layer_trends(spark, sf):
    return dash.second_layer_trends(t.closes(spark, sf))


@query("second_layer_trends_weekly", s.with_(_trend_sql("weekly"), *BASE, "weekly", TREND_NAMES))
def second_layer_trends_weekly(spark, sf):
    return dash.second_layer_trends(t.closes(spark, sf), weekly=True)


def _every_trend(value: str, up: str, down: str) -> str:
    a, b = f"lag({value}, 2) OVER w", f"lag({value}, 1) OVER w"
    return (f"CASE WHEN {value} > {b} AND {b} > {a} THEN '{up}' WHEN {value} < {b} AND {b} < {a} THEN '{down}' ELSE '震盪' END")


@query("trend3_every_day", s.with_(f"""
SELECT symbol, {s.day('dt')} AS dt, {_every_trend('close', '連續上升', '連續下降')} AS raw_trend,
       {_every_trend(s.r('close', 2), '持續上升', '連續回落')} AS value_trend
FROM closes WINDOW w AS (PARTITION BY symbol ORDER BY dt)""", *BASE))
def trend3_every_day(spark, sf):
    last3 = series.by_day("symbol").rowsBetween(-2, 0)
    rows = t.closes(spark, sf).withColumn("v", F.collect_list("close").over(last3))
    rounded = F.transform("v", lambda x: rnd(x, 2))
    return rows.select("symbol", day("dt").alias("dt"), series.trend_of(F.col("v"), "連續上升", "連續下降").alias("raw_trend"),
                       series.trend_of(rounded, "持續上升", "連續回落").alias("value_trend"))


# ---- macro -----------------------------------------------------------------

@query("macro_csv_scan", s.with_("SELECT series, ds AS dt, value FROM lines WHERE value IS NOT NULL", "lines"))
def macro_csv_scan(spark, sf):
    return readers.parse_macro_lines(t.macro_lines(spark, sf)).select("series", day("dt").alias("dt"), "value")


CHG = f"""changes AS (
  SELECT series, max(dt) AS data_date, max(CASE WHEN rn = 1 THEN value END) AS latest, max(CASE WHEN rn = 2 THEN value END) AS previous
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt DESC) AS rn FROM lines WHERE value IS NOT NULL)
  WHERE rn <= 2 GROUP BY series HAVING count(*) = 2),
moves AS (SELECT *, latest - previous AS chg, CASE WHEN CASE series WHEN 'nfci' THEN NOT (latest > previous) WHEN 'reserves' THEN latest > previous
  ELSE latest < previous END THEN 'pos' ELSE 'neg' END AS dir FROM changes)"""


@query("macro_change", s.with_(f"""
SELECT series, {s.day('data_date')} AS data_date, {s.r('latest', 3)} AS value, {s.r('chg', 3)} AS change, dir,
  CASE WHEN series = 'nfci' THEN printf('%.3f', {s.r('latest', 3)}) ELSE '$' || printf('%.0f', {s.r('latest', 0)}) || 'B' END AS val_str,
  CASE WHEN chg > 0 THEN '▲ ' ELSE '▼ ' END || CASE WHEN series = 'nfci' THEN printf('%.3f', {s.r('abs(chg)', 3)})
  ELSE printf('%.0f', {s.r('abs(chg)', 0)}) || 'B' END AS chg_str FROM moves""", "lines", CHG))
def macro_change(spark, sf):
    out = dash.macro_changes(readers.parse_macro_lines(t.macro_lines(spark, sf)))
    return out.withColumn("data_date", day("data_date"))


MACRO_SPEC = s.values("spec", "pos, series, label, up, down, rising_good", [(i, *m) for i, m in enumerate(dims.MACRO)])


@query("liquidity_score", s.with_("""
SELECT score, CASE WHEN score >= 2 THEN '流動性寬鬆' WHEN score <= -2 THEN '流動性收縮' ELSE '流動性中性' END AS label,
       CASE WHEN score >= 2 THEN 'pos' WHEN score <= -2 THEN 'neg' ELSE 'neu' END AS color, coalesce(signals, '') AS signals FROM (
  SELECT CAST(coalesce(sum(CASE dir WHEN 'pos' THEN 1 WHEN 'neg' THEN -1 ELSE 0 END), 0) AS INTEGER) AS score,
         string_agg(CASE WHEN (dir = 'pos') = rising_good THEN up ELSE down END, ', ' ORDER BY pos) FILTER (WHERE dir IS NOT NULL) AS signals
  FROM spec LEFT JOIN moves USING (series))""", "lines", CHG, MACRO_SPEC))
def liquidity_score(spark, sf):
    return dash.liquidity_score(dash.macro_changes(readers.parse_macro_lines(t.macro_lines(spark, sf))))


@query("nfci_trend", s.with_(f"""
SELECT {s.day('d')} AS latest_date, {s.r('v[-1]', 2)} AS latest_value, {s.r('v[-2]', 2)} AS prev_week, {s.r('v[-1] - v[-2]', 2)} AS week_change,
  CASE WHEN len(v) < 4 THEN '—' WHEN v[-1] > v[-4] + 0.05::DOUBLE THEN 'tightening' WHEN v[-1] < v[-4] - 0.05::DOUBLE THEN 'easing' ELSE 'stable' END AS trend
FROM (SELECT list(value ORDER BY dt) AS v, max(dt) AS d FROM lines WHERE series = 'nfci' AND value IS NOT NULL)""", "lines"))
def nfci_trend(spark, sf):
    out = dash.conditions_trend(readers.parse_macro_lines(t.macro_lines(spark, sf)))
    return out.withColumn("latest_date", day("latest_date"))


CREDIT = """legs AS (
  SELECT symbol, arg_min(close, dt) AS f, arg_max(close, dt) AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM closes WHERE symbol IN ('HYG', 'LQD')) WHERE rn <= 5 GROUP BY symbol),
panel AS (SELECT (h.l - h.f) / h.f * 100 AS hyg, (q.l - q.f) / q.f * 100 AS lqd, (h.l / q.l - h.f / q.f) / (h.f / q.f) * 100 AS chg
  FROM legs h, legs q WHERE h.symbol = 'HYG' AND q.symbol = 'LQD')"""


@query("credit_panel", s.with_(f"""
SELECT {s.fmt_signed('hyg', 2)} AS hyg_weekly_return, {s.fmt_signed('lqd', 2)} AS lqd_weekly_return, {s.fmt_signed('chg', 3)} AS hyg_lqd_ratio_change,
  CASE WHEN hyg < -3 THEN '低' WHEN hyg > -1 AND lqd > -1 THEN '高' WHEN hyg IS NOT NULL THEN '中' END AS reliability FROM panel""", *BASE, CREDIT))
def credit_panel(spark, sf):
    return dash.credit_panel(t.closes(spark, sf))


CHAIN = """chain AS (
  SELECT 'U' || l_linestatus AS underlying, last_day(CAST(l_shipdate AS DATE)) AS expiry, CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END AS side,
         CASE WHEN l_discount <> 0.05 THEN l_quantity END AS volume FROM lineitem)"""
PC = f"""pc AS (SELECT underlying, expiry, {s.r("CASE WHEN sum(CASE WHEN side = 'call' THEN volume END) > 0 THEN sum(CASE WHEN side = 'put' THEN volume END) / sum(CASE WHEN side = 'call' THEN volume END) END", 2)} AS pc_ratio
  FROM chain GROUP BY 1, 2)"""


@query("put_call", s.with_(f"SELECT underlying, {s.day('expiry')} AS expiry, pc_ratio FROM pc", CHAIN, PC))
def put_call(spark, sf):
    return dash.put_call(t.option_chain(spark, sf)).withColumn("expiry", day("expiry"))


@query("option_chain_nearest", s.with_(f"""
SELECT underlying, side, {s.day('expiry')} AS expiry, count(*) AS n, {s.r('sum(volume)', 2)} AS volume FROM chain
WHERE expiry = (SELECT min(expiry) FROM chain WHERE expiry >= DATE '1999-07-04') GROUP BY ALL""", CHAIN))
def option_chain_nearest(spark, sf):
    near = dash.nearest_expiry(t.option_chain(spark, sf), F.lit("1999-07-04").cast("date"))
    return near.groupBy("underlying", "side", day("expiry").alias("expiry")).agg(
        F.count("*").alias("n"), rnd(F.sum("volume"), 2).alias("volume"))


@query("options_panel", s.with_("""
SELECT *, CASE WHEN vix_spot < vix_other THEN 'contango' WHEN vix_spot > vix_other THEN 'backwardation' ELSE 'flat' END AS term_structure,
  (SELECT pc_ratio FROM pc WHERE underlying = 'UO' AND expiry >= DATE '1999-07-04' ORDER BY expiry LIMIT 1) AS pc_ratio
FROM (SELECT """ + ", ".join(f"(SELECT {s.r('new', 2)} FROM points WHERE symbol = '{sym}') AS {name}" for sym, name in (("^VIX", "vix_spot"), ("^VIX9D", "vix_other"), ("^VVIX", "vvix"))) + ")",
    *BASE, s.points(), CHAIN, PC))
def options_panel(spark, sf):
    return dash.options_panel(t.closes(spark, sf), t.option_chain(spark, sf), F.lit("1999-07-04").cast("date"), "UO")


# ---- rule bands over whole histories ---------------------------------------

def wide_days(spark, sf, symbols: list[str]):
    """One row per trading day with the newest close of every symbol so far."""
    names = {sym: f"s{i}" for i, sym in enumerate(symbols)}
    rows = t.closes(spark, sf).filter(F.col("symbol").isin(symbols))
    wide = rows.groupBy("dt").agg(*[F.max(F.when(F.col("symbol") == sym, F.col("close"))).alias(n) for sym, n in names.items()])
    so_far = W.partitionBy(F.lit(1)).orderBy("dt")  # one row per trading day
    return wide.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in names.values()}).dropna()


def wide_sql(symbols: list[str]) -> str:
    picks = ", ".join(f"max(CASE WHEN symbol = '{sym}' THEN close END) AS s{i}" for i, sym in enumerate(symbols))
    keep = " AND ".join(f"s{i} IS NOT NULL" for i in range(len(symbols)))
    listed = ", ".join(s.lit(x) for x in symbols)
    filled = ", ".join(f"last_value(s{i} IGNORE NULLS) OVER (ORDER BY dt) AS s{i}" for i in range(len(symbols)))
    return f"wide AS (SELECT * FROM (SELECT dt, {filled} FROM (SELECT dt, {picks} FROM closes WHERE symbol IN ({listed}) GROUP BY dt)) WHERE {keep})"


BAND_SYMBOLS = ["^VIX", "^VIX9D", "^SKEW", "^VVIX", "^IRX", "^TNX"]


@query("sentiment_tags", s.with_(f"""
SELECT {s.day('dt')} AS dt, CASE WHEN s2 > 140 THEN '尾部風險' END AS tail, CASE WHEN s3 > 120 THEN '高波動' END AS vol,
  CASE WHEN abs(s1 - s0) < 1 THEN NULL WHEN s1 < s0 THEN '短期恐慌' ELSE '持續風險' END AS panic,
  CASE WHEN s1 - s0 < -1 THEN '短期恐慌' WHEN s1 - s0 > 1 THEN '持續風險' END AS panic_weekly,
  CASE WHEN s0 < s1 THEN 'contango' WHEN s0 > s1 THEN 'backwardation' ELSE 'flat' END AS term,
  CASE WHEN s3 > 120 THEN 'high' WHEN s3 >= 80 THEN 'elevated' ELSE 'calm' END AS move_band,
  CASE WHEN s0 * 2 <= 25 THEN 'extreme_fear' WHEN s0 * 2 <= 45 THEN 'fear' WHEN s0 * 2 <= 55 THEN 'neutral' WHEN s0 * 2 <= 75 THEN 'greed' ELSE 'extreme_greed' END AS fg_band
FROM wide""", *BASE, wide_sql(BAND_SYMBOLS)))
def sentiment_tags(spark, sf):
    c = [F.col(f"s{i}") for i in range(6)]
    return wide_days(spark, sf, BAND_SYMBOLS).select(
        day("dt").alias("dt"), rules.tail_tag(c[2]).alias("tail"), rules.vol_tag(c[3]).alias("vol"),
        rules.short_panic_tag(c[0], c[1]).alias("panic"), rules.short_panic_tag(c[0], c[1], strict=True).alias("panic_weekly"),
        rules.term_structure(c[0], c[1]).alias("term"), rules.move_band(c[3]).alias("move_band"),
        rules.fear_greed_band(c[0] * 2).alias("fg_band"))


@query("curve_state", s.with_(f"""
SELECT {s.day('dt')} AS dt, s4 > s5 AS inverted, CASE WHEN s5 - s4 < -0.1 THEN '倒掛' WHEN s5 - s4 > 0.1 THEN '正常' ELSE '趨平' END AS curve
FROM wide""", *BASE, wide_sql(BAND_SYMBOLS)))
def curve_state(spark, sf):
    us2y, us10y = F.col("s4"), F.col("s5")
    return wide_days(spark, sf, BAND_SYMBOLS).select(
        day("dt").alias("dt"), rules.is_inverted(us2y, us10y).alias("inverted"), rules.curve_tag(us10y - us2y).alias("curve"))


STYLE_SYMBOLS = ["^NDX", "FNGS", "VTV", "VUG", "MTUM", "RSP", "SPY", "IWM", "HYG", "LQD"]
STYLE_CHG = "chg AS (SELECT dt, " + ", ".join(
    f"(s{i} - lag(s{i}) OVER (ORDER BY dt)) / lag(s{i}) OVER (ORDER BY dt) * 100 AS c{i}" for i in range(10)) + """,
  (s5 / s6) / lag(s5 / s6) OVER (ORDER BY dt) - 1 AS rsp, (s7 / s6) / lag(s7 / s6) OVER (ORDER BY dt) - 1 AS iwm,
  (s8 / s9) / lag(s8 / s9) OVER (ORDER BY dt) - 1 AS hl FROM wide)"""


@query("style_tags", s.with_(f"""
SELECT {s.day('dt')} AS dt, CASE WHEN c0 < 0 AND c1 < c0 THEN '科技巨頭領跌' WHEN c0 < 0 AND c1 > c0 THEN '巨頭相對抗跌' END AS mega,
  CASE WHEN rsp > 0 THEN '市場變寬' WHEN rsp < 0 THEN '市場集中' END AS breadth, CASE WHEN iwm > 0 THEN '小型股強' WHEN iwm < 0 THEN '大型股主導' END AS small,
  CASE WHEN c2 > c3 THEN 'defensive' WHEN c2 < c3 THEN 'growth' WHEN c2 = c3 THEN 'balanced' END AS rotation,
  CASE WHEN c4 > c0 THEN 'momentum_holds' WHEN c4 < c0 THEN 'momentum_breaks' WHEN c4 = c0 THEN 'in_line' END AS momentum,
  CASE WHEN rsp > 0 AND iwm > 0 THEN '真正變寬' WHEN rsp < 0 AND iwm < 0 THEN '高度集中化' WHEN rsp > 0 AND iwm < 0 THEN '部分寬化' WHEN rsp IS NOT NULL AND iwm IS NOT NULL THEN '混合' END AS combo,
  CASE WHEN hl > 0 THEN '↑利差收窄' WHEN hl <= 0 THEN '↓利差擴大' END AS credit,
  CASE WHEN c8 > 0 THEN '寬鬆' WHEN c8 IS NULL THEN '中性' ELSE '收緊' END AS capital,
  CASE WHEN c8 < -3 THEN '低' WHEN c8 > -1 AND c9 > -1 THEN '高' WHEN c8 IS NOT NULL THEN '中' END AS reliability
FROM chg""", *BASE, wide_sql(STYLE_SYMBOLS), STYLE_CHG))
def style_tags(spark, sf):
    w = W.partitionBy(F.lit(1)).orderBy("dt")  # one row per trading day
    rows = wide_days(spark, sf, STYLE_SYMBOLS)
    ratio_change = lambda a, b: (F.col(a) / F.col(b)) / F.lag(F.col(a) / F.col(b)).over(w) - 1
    c = {f"c{i}": pct_change(F.col(f"s{i}"), F.lag(f"s{i}").over(w)) for i in range(10)}
    chg = rows.withColumns({**c, "rsp": ratio_change("s5", "s6"), "iwm": ratio_change("s7", "s6"), "hl": ratio_change("s8", "s9")})
    col = F.col
    return chg.select(
        day("dt").alias("dt"), rules.mega_cap_tag(col("c0"), col("c1")).alias("mega"), rules.breadth_tag(col("rsp")).alias("breadth"),
        rules.small_cap_tag(col("iwm")).alias("small"), rules.style_rotation(col("c2"), col("c3")).alias("rotation"),
        rules.momentum_read(col("c4"), col("c0")).alias("momentum"), rules.breadth_combination(col("rsp"), col("iwm")).alias("combo"),
        rules.credit_spread_label(col("hl")).alias("credit"), rules.capital_label(num.direction(col("c8"))).alias("capital"),
        rules.credit_reliability(col("c8"), col("c9")).alias("reliability"))


@query("nfci_band", s.with_("""
SELECT ds AS dt, value, CASE WHEN value > 0.5 THEN '金融條件偏緊' WHEN value > 0 THEN '略偏緊' WHEN value > -0.5 THEN 'neutral' ELSE '金融條件寬鬆' END AS band
FROM lines WHERE series = 'nfci' AND value IS NOT NULL""", "lines"))
def nfci_band(spark, sf):
    rows = readers.parse_macro_lines(t.macro_lines(spark, sf)).filter(F.col("series") == "nfci")
    return rows.select(day("dt").alias("dt"), "value", rules.nfci_band(F.col("value")).alias("band"))


def _stage_inputs(weekly: bool) -> tuple[str, str]:
    source = "weekly" if weekly else "closes"
    n = 8 if weekly else 5
    drift = "高位震盪後回落" if weekly else None
    cte = f"""vv AS (
  SELECT dt, v, {s.three('v', '持續上升', '連續回落', drift)} AS trend, len(v) - list_position(v, list_max(v)) AS ago,
         {s.r('(list_max(v) - v[-1]) / list_max(v) * 100', 1)} AS decline FROM (
    SELECT dt, list({s.r('close', 2)}) OVER (ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v FROM {source} WHERE symbol = '^VVIX'))"""
    days = f"""days4 AS (
  SELECT * FROM (SELECT dt, last_value(vix IGNORE NULLS) OVER (ORDER BY dt) AS vix, last_value(skew IGNORE NULLS) OVER (ORDER BY dt) AS skew,
    last_value(fg IGNORE NULLS) OVER (ORDER BY dt) AS fg FROM (
      SELECT dt, max(CASE WHEN symbol = '^VIX' THEN close END) AS vix, max(CASE WHEN symbol = '^SKEW' THEN close END) AS skew,
             max(CASE WHEN symbol = '^VIX9D' THEN close END) AS fg FROM {source} GROUP BY dt))
  JOIN vv USING (dt) WHERE vix IS NOT NULL AND skew IS NOT NULL AND fg IS NOT NULL)"""
    return cte, days


def _stage_frame(spark, sf, weekly: bool):
    closes, n = t.closes(spark, sf), 8 if weekly else 5
    if weekly:
        closes = series.weekly(closes).select("symbol", F.col("week").alias("dt"), "close")
    frame = series.by_day("symbol").rowsBetween(1 - n, 0)
    vv = closes.filter(F.col("symbol") == "^VVIX").select("dt", F.collect_list(rnd(F.col("close"), 2)).over(frame).alias("v"))
    peak = series.peak_of(F.col("v"))
    vv = vv.select("dt", F.try_element_at("v", F.lit(-1)).alias("vvix"), peak.alias("peak"),
                   series.trend_of(F.col("v"), "持續上升", "連續回落", drift="高位震盪後回落" if weekly else None).alias("trend"))
    leg = lambda sym: F.max(F.when(F.col("symbol") == sym, F.col("close")))
    days = closes.groupBy("dt").agg(leg("^VIX").alias("vix"), leg("^SKEW").alias("skew"), leg("^VIX9D").alias("fg"))
    so_far = W.partitionBy(F.lit(1)).orderBy("dt")  # one row per trading day
    days = days.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("vix", "skew", "fg")}).dropna()
    return days.join(vv, "dt")


@query("sentiment_stage", s.with_(f"""
SELECT {s.day('dt')} AS dt, CASE WHEN vix > 35 AND ago >= 2 AND skew < 120 THEN '第三階段' WHEN vix > 30 AND (ago <= 1 OR trend = '持續上升') THEN '第二階段'
    WHEN vix < 20 AND skew > 135 THEN '第一階段' ELSE '無明確訊號' END AS stage,
  CASE WHEN vix > 40 AND ago >= 2 AND skew < 120 AND decline > 10 AND fg < 20 THEN '高' ELSE '中' END AS reliability FROM days4""",
    *BASE, *_stage_inputs(False)))
def sentiment_stage(spark, sf):
    c = F.col
    rows = _stage_frame(spark, sf, False)
    stage = rules.sentiment_stage(c("vix"), c("vvix"), c("skew"), c("fg"), c("trend"), c("peak.ago"), c("peak.decline_pct"))
    return rows.withColumn("st", stage).select(day("dt").alias("dt"), "st.stage", "st.reliability")


@query("sentiment_stage_weekly", s.with_(f"""
SELECT {s.day('dt')} AS dt, CASE WHEN vix > 35 AND ago >= 2 AND skew < 120 AND trend IN ('連續回落', '高位震盪後回落') THEN '第三階段'
    WHEN vix > 30 AND trend = '持續上升' THEN '第二階段' WHEN vix < 20 AND skew > 135 THEN '第一階段' ELSE '無明確訊號' END AS stage,
  CASE WHEN vix > 40 AND ago >= 2 AND skew < 120 AND trend IN ('連續回落', '高位震盪後回落') AND decline > 15 AND fg < 20 THEN '高' ELSE '中' END AS reliability
FROM days4""", *BASE, "weekly", *_stage_inputs(True)))
def sentiment_stage_weekly(spark, sf):
    c = F.col
    rows = _stage_frame(spark, sf, True)
    stage = rules.sentiment_stage_weekly(c("vix"), c("skew"), c("fg"), c("trend"), c("peak.ago"), c("peak.decline_pct"), F.lit("震盪"))
    return rows.withColumn("st", stage).select(day("dt").alias("dt"), "st.stage", "st.reliability")


CONFIRM_SYMBOLS = ["GC=F", "BTC-USD", "JPY=X", "DX-Y.NYB", "HYG"]


def _confirm_trend(i: int) -> str:
    return (f"CASE WHEN s{i} > lag(s{i}) OVER o AND lag(s{i}) OVER o > lag(s{i}, 2) OVER o THEN '連續上升' "
            f"WHEN s{i} < lag(s{i}) OVER o AND lag(s{i}) OVER o < lag(s{i}, 2) OVER o THEN '連續下降' ELSE '震盪' END AS t{i}")


@query("cross_asset_confirm", s.with_(f"""
SELECT {s.day('dt')} AS dt, CAST(n AS INTEGER) AS confirming, n >= 2 AS is_confirmed, array_to_string(list_filter([
  CASE WHEN t0 = '連續上升' AND t1 <> '連續上升' THEN '避險需求主導' END, CASE WHEN t0 = '連續下降' THEN '流動性危機' END,
  CASE WHEN t3 = '連續上升' AND t4 = '連續下降' THEN '美元收緊流動性' END, CASE WHEN t1 = '連續上升' AND t0 <> '連續上升' THEN '風險偏好率先回升' END],
  lambda x: x IS NOT NULL), '、') AS combinations FROM (
  SELECT *, (CASE WHEN t0 <> '連續下降' THEN 1 ELSE 0 END + CASE WHEN t1 = '連續上升' THEN 1 ELSE 0 END
    + CASE WHEN t2 <> '連續上升' THEN 1 ELSE 0 END + CASE WHEN t3 <> '連續上升' THEN 1 ELSE 0 END) AS n
  FROM (SELECT dt, {', '.join(_confirm_trend(i) for i in range(5))} FROM wide WINDOW o AS (ORDER BY dt)))""", *BASE, wide_sql(CONFIRM_SYMBOLS)))
def cross_asset_confirm(spark, sf):
    w = W.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(-2, 0)  # one row per trading day
    trends = {f"t{i}": series.trend_of(F.collect_list(f"s{i}").over(w), "連續上升", "連續下降") for i in range(5)}
    rows = wide_days(spark, sf, CONFIRM_SYMBOLS).withColumns(trends)
    gold, btc, jpy, dxy, hyg = (F.col(f"t{i}") for i in range(5))
    n = rules.confirmations(gold, btc, jpy, dxy)
    return rows.select(day("dt").alias("dt"), n.alias("confirming"), (n >= 2).alias("is_confirmed"),
                       rules.combination_signals(gold, btc, dxy, hyg, F.lit("震盪"), F.lit("震盪")).alias("combinations"))
