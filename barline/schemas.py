"""Schemas of the logical tables, as DDL text: importing them needs no session."""

from __future__ import annotations

BARS = "ticker string, dt date, open double, high double, low double, close double, volume double"
CLOSES = "symbol string, dt date, close double"
MACRO = "series string, dt date, value double"
MACRO_FILE = "dt string, value string"
WATCH_SHEET = "ticker string, cik string, name string, sector string"
SNAPSHOT_ROW = (
    "Rank int, Ticker string, Sector string, RS_Score double, rs_1w double, rs_4w double, rs_13w double, "
    "rs_trend string, Contraction_Score double, Combined_Score double, Price double, vs_200MA_pct double, "
    "Rank_Change int, Rank_Change_Str string"
)
SNAPSHOT_DOC = f"date string, total int, data array<struct<{SNAPSHOT_ROW.replace(' ', ':').replace(',:', ',')}>>"
NEWS_ITEM = "feed string, pos bigint, title string, summary string, link string, inner_source string, published timestamp"
WATCH_DOC = "as_of string, stocks array<struct<ticker:string,name:string,moat_grade:string,pass_count:int>>"
FALSIFIERS = "array<struct<metric:string,op:string,threshold:double,meaning:string>>"
REGIME = (
    "as_of date, call string, confidence string, confidence_reason string, for_ranking string, "
    "axes map<string,struct<state:string,evidence:string>>, confirms array<string>, contradicts array<string>, "
    f"falsifiers {FALSIFIERS}"
)
