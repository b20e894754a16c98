from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barline.functions import dates, numeric as num
from barline.operators import series
from barline.plans import dashboard as dash
from barline.plans import screener as scr
from barline.sources import dims

DAY0 = date(2024, 1, 1)


def closes(spark, table, key="symbol"):
    data = [(k, DAY0 + timedelta(days=i), None if v is None else float(v)) for k, vs in table.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, f"{key} string, dt date, close double")


def test_history_gates(spark):
    sizes = [4, 5, 20, 21, 62, 63, 149, 150, 199, 200]
    bars = closes(spark, {f"n{n:03d}": range(1, n + 1) for n in sizes}, "ticker")
    got = {r["ticker"]: r for r in scr.latest_returns(bars).collect()}
    for n in sizes:
        row = got[f"n{n:03d}"]
        assert (row["ret_1w"] is not None) == (n >= 5)
        assert (row["ret_4w"] is not None) == (n >= 21)
        assert (row["ret_13w"] is not None) == (n >= 63)
    assert got["n005"]["ret_1w"] == pytest.approx((5 - 1) / 1 * 100)
    bench = closes(spark, {"b": range(1, 201)}).select("dt", "close")
    assert {r["ticker"] for r in scr.rs_score(bars, bench).collect()} == {f"n{n:03d}" for n in sizes if n >= 63}
    assert {r["ticker"] for r in scr.ma_position(bars).collect()} == {"n200"}


def test_missing_rows_do_not_count(spark):
    df = closes(spark, {"a": [1, None, 2, float("nan"), 3]})
    assert [r["close"] for r in series.last_rows(series.drop_missing(df), "symbol", 2).orderBy("dt").collect()] == [2.0, 3.0]


@pytest.mark.parametrize("values,label", [([1, 2, 3], "U"), ([3, 2, 1], "D"), ([1, 1, 2], "flat"), ([5, 1, 3], "drift"), ([1, 2], "flat"), ([], "flat")])
def test_trend(spark, values, label):
    df = spark.createDataFrame([(values,)], "v array<int>")
    assert df.select(series.trend_of(F.col("v"), "U", "D", "flat", "drift")).first()[0] == label


def test_peak_takes_first_maximum(spark):
    df = spark.createDataFrame([([1.0, 9.0, 3.0, 9.0, 6.0],), ([],)], "v array<double>")
    a, b = (r[0] for r in df.select(series.peak_of(F.col("v"))).collect())
    assert (a["ago"], a["peak"], a["decline_pct"]) == (3, 9.0, 33.3)
    assert (b["ago"], b["peak"], b["decline_pct"]) == (0, 0.0, 0.0)


def test_week_across_new_year(spark):
    rows = [("a", date(2025, 12, 26), 1.0), ("a", date(2025, 12, 29), 2.0), ("a", date(2025, 12, 31), 3.0), ("a", date(2026, 1, 2), 4.0),
            ("a", date(2026, 1, 3), 9.0), ("b", date(2026, 1, 2), 5.0), ("c", date(2025, 12, 26), 6.0), ("c", date(2026, 1, 2), 7.0)]
    got = {r["symbol"]: (r["first"], r["last"]) for r in series.week_first_last(spark.createDataFrame(rows, "symbol string, dt date, close double")).collect()}
    assert got == {"a": (2.0, 4.0), "b": (5.0, 5.0), "c": (6.0, 7.0)}  # weekend row ignored; single days fall back to all rows


def test_carry_fills_every_session(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 4), 2.0), ("b", date(2024, 1, 3), 5.0)], "k string, dt date, close double")
    got = series.carry_to_sessions(df, series.sessions(df), "k").select("k", "as_of", "close").collect()
    assert sorted((r[0], r[1].day, r[2]) for r in got) == [("a", 1, 1.0), ("a", 3, 1.0), ("a", 4, 2.0), ("b", 3, 5.0), ("b", 4, 5.0)]


def test_zero_change_and_missing(spark):
    df = spark.createDataFrame([(0.0, False), (0.0, True), (1.0, True), (None, False)], "c double, inv boolean")
    rows = df.select(num.direction(F.col("c"), F.col("inv")), num.ratio_direction(F.col("c")), num.fmt_change(F.col("c"), F.lit("pct"))).collect()
    assert [r[0] for r in rows] == ["neg", "pos", "neg", "neu"]
    assert [r[1] for r in rows] == ["neu", "neu", "pos", "neu"]
    assert [r[2] for r in rows] == ["▼ 0.00%", "▼ 0.00%", "▲ 1.00%", "—"]
    zero = spark.createDataFrame([(5.0, 0.0), (5.0, None)], "a double, b double")
    assert [r[0] for r in zero.select(num.pct_change(F.col("a"), F.col("b"))).collect()] == [None, None]


def test_rounding_is_half_up_on_decimals(spark):
    df = spark.createDataFrame([(2.675,), (0.25,), (50.349999999999994,)], "x double")
    assert [r[0] for r in df.select(num.rnd(F.col("x"), 2)).collect()] == [2.68, 0.25, 50.35]


def test_dashboard_with_missing_legs(spark):
    df = closes(spark, {"RSP": [10, 11], "SPY": [20, 20], "HYG": [5], "^TNX": [4, 4.5], "^IRX": [4.2, 4.2], "^VIX": [20, 22], "XLE": [10, 12]})
    items = {r["key"]: r for r in dash.market_daily(df, dims.instruments(spark)).collect()}
    assert items["rsp_spy"]["chg_str"] == "▲ 10.00%" and items["rsp_spy"]["val_str"] == "0.5500"
    assert items["hyg_lqd"]["val_str"] == "—" and items["hyg_lqd"]["dir"] == "neu"
    assert items["curve"]["chg_str"] == "▲ 50bps" and items["curve"]["dir"] == "pos"
    assert items["vix"]["dir"] == "neg" and items["ndx"]["val_str"] == "—"
    assert items["XLE"]["is_dynamic"] and "CL=F" not in items


def test_ratio_trend_by_day_or_position(spark):
    days = lambda ds, vs, k: [(k, DAY0 + timedelta(days=d), float(v)) for d, v in zip(ds, vs)]
    df = spark.createDataFrame(days([0, 1, 2, 3], [1, 2, 3, 9], "A") + days([0, 1, 3], [1, 1, 1], "B"), "symbol string, dt date, close double")
    b = df.filter("symbol = 'B'").withColumn("close", F.when(F.col("dt") == F.lit(DAY0 + timedelta(days=3)), 9.0).otherwise(F.col("close")))
    df = df.filter("symbol = 'A'").unionByName(b)  # by day: 1, 2, 1; by position: 2, 3, 1
    got = {strict: dash.ratio_trends(df, {"x": ("A", "B")}, strict).first()["trend"] for strict in (False, True)}
    assert got == {False: "震盪", True: "震盪"}
    rising = df.withColumn("close", F.when((F.col("symbol") == "B") & (F.col("close") == 9), 1.0).otherwise(F.col("close")))
    assert dash.ratio_trends(rising, {"x": ("A", "B"), "y": ("B", "A")}).orderBy("name").collect()[1]["trend"] == "連續收縮"


def test_conditions_trend_short(spark):
    df = closes(spark, {"nfci": [0.1, 0.2]}).withColumnsRenamed({"symbol": "series", "close": "value"})
    row = dash.conditions_trend(df).first()
    assert row["trend"] == "—" and row["week_change"] == 0.1


def test_calendar_rules(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-06-08 12:00:00'), (timestamp_ntz'2024-06-07 21:14:00'), (timestamp_ntz'2024-06-07 21:15:00'), (timestamp_ntz'2024-06-10 03:00:00') t(now)")
    rows = df.select(dates.session_date(F.col("now")), dates.next_session(F.col("now"))).collect()
    assert [(r[0].day, r[1].day) for r in rows] == [(7, 10), (6, 7), (7, 10), (7, 10)]
    cut = spark.sql("SELECT * FROM VALUES (date'2024-06-10'), (date'2024-06-12') t(d)").select(dates.news_cutoff(F.col("d"))).collect()
    assert [r[0] for r in cut] == [date(2024, 6, 7), date(2024, 6, 10)]


def test_dead_names_leave(spark):
    first = date(2020, 1, 1)
    rows = [("live", first + timedelta(days=d), float(d + 1)) for d in range(0, 1000, 2)] + [("dead", first + timedelta(days=d), float(d + 1)) for d in range(200)]
    bars = spark.createDataFrame(rows, "ticker string, dt date, close double")
    assert [r["ticker"] for r in scr.latest_returns(bars).collect()] == ["live"]
    filled = series.carry_to_sessions(bars.select("ticker", "dt", "close"), series.sessions(bars), "ticker")
    last = {r["ticker"]: r["d"] for r in filled.groupBy("ticker").agg(F.max("as_of").alias("d")).collect()}
    assert last == {"live": first + timedelta(days=998), "dead": first + timedelta(days=498)}  # 199 + 300, sessions are even days
