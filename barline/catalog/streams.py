"""Registered queries: streams run to the end of the data, with batch SQL as their check."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from barline.catalog import sql as s
from barline.catalog.newsdesk import ITEMS, KEY
from barline.catalog.registry import day, query
from barline.functions.numeric import rnd
from barline.operators import series, smoothing
from barline.plans.screener import session_numbers
from barline.session import work_folder
from barline.sources import driver_tables as t
from barline.streaming import jobs


def stream_of(spark, sf, name: str):
    return jobs.read_table(spark, f"{sf}/{name}.parquet", t.table(spark, sf, name).schema)


@query("stream_title_dedup", s.with_(f"SELECT DISTINCT {KEY.format('title')} AS title_key FROM items", ITEMS))
def stream_title_dedup(spark, sf):
    docs = stream_of(spark, sf, "documents")
    items = t.news_entries(docs).withColumn("published", F.col("published").cast("timestamp")).select("title", "published", "pos")
    return jobs.run_available(jobs.dedup_titles(items), "titles").select("title_key")


@query("stream_latest_two", """
SELECT event_type AS symbol, max(CASE WHEN rn = 1 THEN value END) AS latest, max(CASE WHEN rn = 2 THEN value END) AS previous, max(n) AS n_seen
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE rn <= 2 GROUP BY event_type""")
def stream_latest_two(spark, sf):
    closes = stream_of(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"))
    table = jobs.run_available(jobs.latest_two(closes), "latest")
    return jobs.newest_state(table).select("symbol", "latest", "previous", "n_seen")


STREAM_RAW = f"""sraw AS MATERIALIZED (
  SELECT ticker, seq, {s.r('volume % 100', 1)} AS raw_1w, {s.r('(volume * 3) % 100', 1)} AS raw_4w, {s.r('(volume * 7) % 100', 1)} AS raw_13w,
         row_number() OVER (PARTITION BY ticker ORDER BY seq) AS k FROM bars JOIN cal ON bars.dt = cal.as_of)"""
STREAM_EMA = s.CTE["ema"].replace("graw", "sraw")


@query("stream_ema_state", s.with_("SELECT ticker, seq, rs_1w, rs_4w, rs_13w FROM ema", "bars", "cal", STREAM_RAW, STREAM_EMA))
def stream_ema_state(spark, sf):
    bars = t.bars(spark, sf)
    numbers = session_numbers(series.sessions(bars)).withColumnRenamed("as_of", "dt")
    raws = {c: rnd((F.col("volume") * m) % 100, 1) for c, m in zip(smoothing.RAW, (1, 3, 7))}
    folder = work_folder(spark, "snapshots")
    bars.join(numbers, "dt").withColumns(raws).select("ticker", "seq", *smoothing.RAW).write.parquet(folder)
    stream = jobs.read_files(spark, folder, spark.read.parquet(folder).schema)
    return jobs.run_available(jobs.smooth_states(stream), "smooth").select("ticker", "seq", *smoothing.SMOOTH)


@query("stream_tumbling_bars", f"""
SELECT event_type AS symbol, {s.day('d')} AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS BIGINT) AS volume
FROM (SELECT *, date_trunc('day', ts) AS d FROM events) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY event_type, d""")
def stream_tumbling_bars(spark, sf):
    ticks = stream_of(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.lit(1).cast("bigint").alias("volume"))
    table = jobs.run_available(jobs.tumbling_bars(ticks), "bars")
    return table.select("symbol", day("start").alias("start"), "open", "high", "low", "close", "volume")


@query("run_days", f"""
SELECT o_orderkey, isodow(o_orderdate) <> 7 AS runs_daily, isodow(o_orderdate) BETWEEN 2 AND 6 AS runs_screen FROM orders""")
def run_days(spark, sf):
    d = F.to_date("o_orderdate")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", jobs.is_run_day(d).alias("runs_daily"), jobs.is_run_day(d, screen=True).alias("runs_screen"))


NEWEST_DAY = "date_trunc('day', (SELECT max(published) FROM items))"


@query("gated_feed_runs", s.with_(f"""
SELECT feed, pos, title, link, CASE WHEN published < {NEWEST_DAY} THEN '2024-06-07' ELSE '2024-06-10' END AS run_day FROM (
  SELECT *, 'https://example.com/' || pos AS link FROM items)""", ITEMS))
def gated_feed_runs(spark, sf):
    """News files that land in two drops: a Friday run takes the first, a Sunday run nothing, a Monday run the second."""
    source, folder = work_folder(spark, "drops"), work_folder(spark, "feed")
    items = t.news_items(spark, sf)
    newest = items.agg(F.date_trunc("day", F.max("published")).alias("newest"))
    placed = items.join(F.broadcast(newest)).withColumn("early", F.coalesce(F.col("published") < F.col("newest"), F.lit(False)))
    friday, sunday, monday = (pd.Timestamp(f"2024-06-{d:02d} 03:00") for d in (7, 9, 10))
    placed.filter("early").drop("early", "newest").write.mode("append").json(source)
    jobs.take_new_files(spark, source, folder, friday)
    placed.filter("NOT early").drop("early", "newest").write.mode("append").json(source)
    jobs.take_new_files(spark, source, folder, sunday)
    table = jobs.take_new_files(spark, source, folder, monday)
    return table.select("feed", "pos", "title", "link", F.date_format("run_at", "yyyy-MM-dd").alias("run_day"))
