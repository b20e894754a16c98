import json
from datetime import date, datetime

from pyspark.sql import functions as F

from barline.plans import documents as docs
from barline.plans import fundamentals as fund
from barline.plans import news
from barline.plans import screener as scr
from barline.sources import dims, readers, sinks


def test_json_repair(spark):
    texts = ['```json\n{"k": 1}\n```', 'Sure: {"k": 2,} done', '{"k": 3\n"tag": "x"}', '{"tag": "a"\n"k": 4}', '{"k": ', "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["doc"]["k"] if r["doc"] else None, r["is_broken"]) for r in docs.parse_replies(df, "k int, tag string").collect()}
    assert got[0] == (1, False) and got[1] == (2, False) and got[3] == (4, False)
    assert got[2][1] and got[4][1] and got[5][1]  # a number before the line break is not mended, cut text is flagged


def test_strings_are_never_mended(spark):
    tag = 'a ,] b ,} c"\n"d }\n"'
    inside = json.dumps(tag)
    texts = [f'{{"k":1,"tag":{inside}}}', f'{{"k":1,"tag":{inside},}}', f'{{"tag":{inside}\n"k":1\n,}}', f'```\n{{"more":[{{"x":"]\\n["}}\n{{"x":""}},]\n"k":1,"tag":{inside}, }}\n```\nas {{agreed}}',
             '{"k":1,"tag":"two\nlines"}', '{"k":1,"tag":"open ,]', '{"k":1,"tag":"' + "x\\\\ ,] " * 5000 + '",}', "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in docs.parse_replies(df, "k int, tag string").collect()}
    assert all((got[i]["doc"]["k"], got[i]["doc"]["tag"], got[i]["is_broken"]) == (1, tag, False) for i in range(4))
    assert got[6]["doc"]["tag"] == "x\\ ,] " * 5000
    assert all(got[i]["is_broken"] for i in (4, 5, 7, 8))


def test_theme_documents_and_regimes_read_back(spark, tmp_path):
    rows = [("2024-01-05", "credit", 1, '{"k": 1}'), ("2024-01-05", "credit", 2, '{"k": 2,}'), ("2024-01-05", "credit", 3, "broken"), ("2024-01-12", "macro", 1, "none")]
    replies = spark.createDataFrame(rows, "as_of string, theme string, at int, text string").withColumn("as_of", F.to_date("as_of"))
    sinks.write_documents(docs.theme_documents(replies, "k int, week_summary string"), str(tmp_path / "t"), "as_of", "theme")
    back = readers.read_theme_docs(spark, str(tmp_path / "t"), "k int, week_summary string, risk_flags array<string>").collect()
    assert [(r.as_of, r.theme, r.pos, r.k, r.week_summary, r.risk_flags) for r in back] == [(date(2024, 1, 5), "credit", 3, 2, "", [])]
    regimes = spark.createDataFrame([(date(2024, 1, d), f"call {d}") for d in (2, 4, 9)], "as_of date, call string")
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3, 4, 5, 9, 10)], "review_day date")
    got = {r.review_day.day: r.regime.as_of.day for r in docs.regime_as_of(regimes, days).collect()}
    assert got == {3: 2, 4: 2, 5: 4, 9: 4, 10: 9}


def test_regime_defaults(spark):
    df = spark.createDataFrame([(None, ["x"]), ("up", None)], "call string, confirms array<string>")
    rows = docs.with_defaults(df, docs.regime_defaults()).collect()
    assert [(r["call"], r["confirms"], r["verdict"], r["falsifiers"]) for r in rows] == [("", ["x"], "無前日資料", []), ("up", [], "無前日資料", [])]


def test_document_defaults(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], None, "x")], "world_news array<string>, sentiment_analysis struct<stage:string,stage_name:string,reliability:string,"
                               "vix_reading:string,vvix_reading:string,skew_reading:string,fear_greed_reading:string,credit_check:string,cross_asset_confirm:string,"
                               "key_divergence:string,reliability_reason:string,one_line:string>, implied_trends string")
    row = docs.daily_document(df).first()
    assert row["world_news"] == ["a", "b", "c"] and row["implied_trends"] == [] and row["macro"] == []
    assert row["sentiment_analysis"]["stage"] == "無明確訊號" and row["market_pulse"]["hidden_risk"] == "" and row["alert"] == ""
    week = docs.weekly_document(spark.createDataFrame([("s",)], "week_summary string"), "earnings", "財報").first()
    assert (week["theme"], week["week_summary"], week["has_earnings"], week["next_week_earnings"]) == ("財報", "s", False, [])
    assert docs.weekly_document(spark.createDataFrame([("s",)], "week_summary string"), "macro", "總經").first()["analyst_views"] == []


def test_trend_defaults(spark):
    df = spark.createDataFrame([([("t", None, ["a", "b", "c", "d"])],)], "items array<struct<title:string,label_type:string,sub_items:array<string>>>")
    row = df.select(docs.trend_defaults(F.col("items"))).first()[0][0]
    assert (row["label_type"], row["sub_items"]) == ("other", ["a", "b", "c"])


def test_snapshot_roundtrip_replaces_one_day(spark, tmp_path):
    cols = sinks.SNAPSHOT_US
    base = spark.range(3).select(*[F.lit("x").alias(c) if c in ("ticker", "sector", "rs_trend", "rank_change_str") else F.col("id").cast("double").alias(c) for c in cols])
    path = str(tmp_path / "snap")
    for day, n in (("2024-01-01", 3), ("2024-01-02", 3), ("2024-01-02", 2)):
        sinks.write_snapshot(base.limit(n).withColumn("as_of", F.lit(day).cast("date")), path)
    back = spark.read.parquet(path)
    assert {str(r[0]): r[1] for r in back.groupBy("as_of").count().collect()} == {"2024-01-01": 3, "2024-01-02": 2}
    assert sinks.latest_snapshot(back).count() == 2
    assert {r["as_of"] for r in readers.newest_before(back, F.lit("2024-01-02").cast("date")).collect()} == {date(2024, 1, 1)}
    pruned = back.filter(F.col("as_of") == F.lit("2024-01-01").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(as_of" in pruned


def test_nested_snapshot_documents(spark, tmp_path):
    doc = {"date": "2024-01-05", "total": 2, "data": [{"Rank": 1, "Ticker": "A", "RS_Score": 90.5}, {"Rank": 2, "Ticker": "B"}]}
    (tmp_path / "2024-01-05.json").write_text(json.dumps(doc))
    rows = readers.read_snapshot_docs(spark, str(tmp_path)).orderBy("Rank").collect()
    assert [(r["as_of"], r["Ticker"], r["RS_Score"]) for r in rows] == [(date(2024, 1, 5), "A", 90.5), (date(2024, 1, 5), "B", None)]


def test_file_scans(spark, tmp_path):
    (tmp_path / "nfci.csv").write_text("DATE,NFCI\n2024-01-05,0.1\n2024-01-12,.\n2024-01-19,\n2024-01-26,x\n2024-02-02,-0.2\n")
    rows = readers.read_macro_csv(spark, str(tmp_path / "nfci.csv"), "nfci").orderBy("dt").collect()
    assert [r["value"] for r in rows] == [0.1, -0.2]
    (tmp_path / "watch.csv").write_text("Title\n\n\n" .replace("\n\n", "\n-,,,\n") + "Ticker,CIK,Name,Sector\n AAA ,1,x, Tech \n,2,y,z\nTOOLONG,3,n,s\nBBB,4,n,\nAAA,5,x,Late\n")
    sheet = {r["ticker"]: r["sector"] for r in readers.read_watch_sheet(spark, str(tmp_path / "watch.csv")).collect()}
    assert sheet == {"AAA": "Late", "BBB": "Unknown"}
    (tmp_path / "dd.json").write_text(json.dumps({"as_of": "x", "stocks": [{"ticker": " A ", "moat_grade": "S"}, {"ticker": ""}, {"name": "n"}]}))
    assert [(r["ticker"], r["name"], r["grade"]) for r in readers.read_watch_doc(spark, str(tmp_path / "dd.json")).collect()] == [("A", "", "S")]


def test_result_and_theme_documents(spark, tmp_path):
    top = spark.createDataFrame([(2, "B"), (1, "A")], "rank int, ticker string")
    picks = spark.createDataFrame([("vcp", "A")], "direction string, ticker string")
    doc = sinks.result_document(top, picks, top, top, total=7)
    row = doc.first()
    assert [r["ticker"] for r in row["top30"]] == ["A", "B"] and row["total_screened"] == 7 and row["top_picks"][0]["direction"] == "vcp"
    themed = spark.createDataFrame([("2024-01-05", th, f"text {th}") for th in dims.THEMES], "as_of string, theme string, week_summary string")
    sinks.write_documents(themed, str(tmp_path / "themes"), "as_of", "theme")
    assert spark.read.json(str(tmp_path / "themes")).count() == 10
    falsifiers = [("VIX", ">", 22.0, "m")]
    regimes = spark.createDataFrame([(date(2024, 1, d), "up", falsifiers) for d in (4, 5)], "as_of date, call string, falsifiers array<struct<metric:string,op:string,threshold:double,meaning:string>>")
    sinks.write_regimes(regimes, str(tmp_path / "regime"))
    back = spark.read.parquet(str(tmp_path / "regime"))
    assert docs.latest_before(back, F.lit("2024-01-05").cast("date")).first()["as_of"] == date(2024, 1, 4)


def test_sheets(spark, tmp_path):
    ranking = spark.createDataFrame([(1, "美國", "^GSPC", 90.0, "震盪", 1.0, 2.0, 3.0, 4.0, 5.0)],
                                    "rank int, name string, ticker string, rs_score double, rs_trend string, rs_1w double, rs_4w double, rs_13w double, vs_benchmark double, price double")
    assert sinks.sector_sheet(ranking).columns[-1] == "股價"
    sheet = sinks.global_sheet(readers.with_region(ranking))
    assert sheet.first()["地區"] == "美洲" and len(sheet.columns) == 10
    sinks.write_sheet(sheet, str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).count() == 1
    assert len(sinks.SCREEN_SHEET) == 18 and len(sinks.SCREEN_SHEET | sinks.FACT_SHEET) == 25


def test_fundamental_fallbacks(spark):
    cols = ("ticker string, trailing_eps double, forward_eps double, eps_next_yr double, free_cashflow double, total_revenue double, roe double, roa double, "
            "op_margin double, gross_margin double, rev_growth double")
    info = spark.createDataFrame([("a", 2.0, 3.0, 4.5, 10.0, 100.0, 0.2, 0.1, 0.3, 0.5, 0.1), ("b", -1.0, None, 2.0, None, 100.0, 0.2, 0.1, None, None, None),
                                  ("c", 1.0, None, None, 5.0, 0.0, None, 0.1, None, None, None)], cols)
    lines = spark.createDataFrame([("a", "Operating Income", date(2023, 1, 1), 1, 50.0), ("a", "Operating Income", date(2024, 1, 1), 2, 100.0), ("a", "Invested Capital", date(2024, 1, 1), 3, 400.0)],
                                  "ticker string, line_item string, period_end date, seq int, value double")
    got = {r["ticker"]: r for r in fund.metrics(info, lines).collect()}
    assert (got["a"]["roic"], got["a"]["roic_source"], got["a"]["eps_cagr_2y"], got["a"]["fcf_margin"]) == (19.8, "ROIC", 50.0, 10.0)
    assert (got["b"]["roic"], got["b"]["roic_source"], got["b"]["eps_cagr_2y"]) == (20.0, "ROE", None)
    assert (got["c"]["roic"], got["c"]["roic_source"], got["c"]["fcf_margin"]) == (10.0, "ROA", None)


def test_second_market_counts_missing_shape_as_50(spark):
    rs = spark.createDataFrame([("a", date(2024, 1, 1), 10.04, 1.0, 80.0, 80.0, 80.0)], "ticker string, as_of date, close double, ret_13w double, rs_1w double, rs_4w double, rs_13w double")
    vcp = spark.createDataFrame([], "ticker string, as_of date, contraction_score double, vcp_pullback_count int, last_pullback_pct double, dist_from_high_pct double, rising_lows boolean, "
                                    "trend_ok boolean, atr_contraction double, price_range_pct double, volume_ratio double, ma200 double")
    members = spark.createDataFrame([("a", "n", "0051")], "ticker string, name string, list string")
    row = scr.screen_tw(rs, vcp, members).first()
    assert (row["contraction_score"], row["combined_score"], row["price"], row["rank"]) == (50.0, 69.2, 10.0, 1)
    assert scr.screen_us(rs, vcp, members.select("ticker", F.lit("s").alias("sector"))).count() == 0


def test_upcoming_reports(spark):
    cal = spark.createDataFrame([("A", date(2024, 6, 10), 8), ("A", date(2024, 6, 11), 8), ("B", date(2024, 6, 10), None), ("C", date(2024, 6, 10), 20)], "ticker string, report_date date, hour int")
    watch = spark.createDataFrame([("A",), ("B",), ("A",)], "ticker string")
    got = news.upcoming_reports(cal, watch, datetime(2024, 6, 8, 12)).collect()
    assert sorted((r["ticker"], r["timing"]) for r in got) == [("A", "before-open"), ("B", "after-close")]


def test_regime_review(spark):
    regimes = spark.createDataFrame([(date(2024, 1, 4), "up", [("VIX", ">", 22.0, ""), ("HYG", "<", 70.0, ""), ("GONE", ">", 1.0, "")])],
                                    "as_of date, call string, falsifiers array<struct<metric:string,op:string,threshold:double,meaning:string>>")
    readings = spark.createDataFrame([(date(2024, 1, 4), "VIX", 30.0), (date(2024, 1, 8), "VIX", 22.5), (date(2024, 1, 8), "HYG", 71.0)], "as_of date, metric string, value double")
    checks = docs.review_regime(regimes, readings)
    assert {r["metric"]: r["hit"] for r in checks.collect()} == {"VIX": True, "HYG": False, "GONE": False}
    assert docs.review_verdict(checks).first()["verdict"] == "被證偽"
