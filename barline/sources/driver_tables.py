"""Logical market and news tables derived from the warehouse tables under one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions.numeric import rnd
from barline.session import shuffle_partitions
from barline.sources import dims

# Level and width that keep each series near its usual reading.
SERIES_RANGE = {
    "vix": (10.0, 40.0), "vix9d": (10.0, 40.0), "skew": (100.0, 60.0), "vvix": (70.0, 80.0),
    "us2y": (3.0, 2.0), "us10y": (3.0, 2.5), "us30y": (3.5, 2.0), "hyg": (75.0, 6.0), "lqd": (105.0, 8.0),
}
DEFAULT_RANGE = (50.0, 150.0)

# Macro series by event type.
MACRO_EVENTS = {"click": "rrp", "view": "tga", "purchase": "reserves", "error": "nfci", "signup": "move"}

NEWS_EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(key: Column) -> Column:
    return F.concat(F.lit("T"), key)


def trade_order() -> Column:
    """Order lines by order, line and part, as one number: a struct here would make every aggregation sort its rows.

    Room for keys of 15 digits and line numbers of four; a larger one fails in the cast, none is taken for another."""
    parts = F.col("l_orderkey").cast("decimal(15,0)"), F.col("l_linenumber").cast("decimal(4,0)"), F.col("l_partkey").cast("decimal(15,0)")
    lines = (parts[0] * F.lit(10**4).cast("decimal(5,0)") + parts[1]).cast("decimal(21,0)")
    return (lines * F.lit(10**15).cast("decimal(16,0)") + parts[2]).cast("decimal(38,0)")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: supplier as ticker, unit price as price, in order-line order."""
    order = trade_order()
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("dt"))
        .agg(
            F.min_by(unit_price, order).alias("open"),
            F.max(unit_price).alias("high"),
            F.min(unit_price).alias("low"),
            F.max_by(unit_price, order).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
        .select(ticker_of(F.col("l_suppkey")).alias("ticker"), "dt", "open", "high", "low", "close", "volume")
    )


def bar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt): the days of all bars, which are those of the order lines, without making the bars."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("dt")).distinct()


def bars_smooth(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """Bars with a 60-row trailing mean price, so that pullbacks look like real ones. `made` are the bars, where they are
    at hand."""
    days = W.partitionBy("ticker").orderBy("dt")
    prices = ["high", "low", "close"]
    # Running totals in whole ten-thousandths: exact, and linear where a sliding mean is not.
    totals = {f"_{c}": F.sum(F.round(F.col(c) * 10000).cast("long")).over(days.rowsBetween(W.unboundedPreceding, 0)) for c in prices}
    width = F.least(F.row_number().over(days), F.lit(60))
    means = {c: rnd((F.col(f"_{c}") - F.coalesce(F.lag(f"_{c}", 60).over(days), F.lit(0))) / width / 10000, 4) for c in prices}
    # One spread by ticker serves this window and all array work that follows.
    spread = (bars(spark, sf_dir) if made is None else made).repartition(shuffle_partitions(spark), "ticker")
    return spread.withColumns(totals).withColumns(means).drop(*totals)


def benchmark_closes(bar_rows: DataFrame) -> DataFrame:
    """Daily mean close over all tickers."""
    return bar_rows.groupBy("dt").agg(rnd(F.avg("close"), 4).alias("close"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector, pos): supplier with its region as sector."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (
        supplier.join(nation, "s_nationkey").join(region, "n_regionkey")
        .select(ticker_of(F.col("s_suppkey")).alias("ticker"), F.col("r_name").alias("sector"),
                F.col("s_suppkey").alias("pos"))
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping lists: every supplier is in at least one of them."""
    base = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("pos"), ticker_of(F.col("s_suppkey")).alias("ticker"), "s_name"
    )
    first, second, third = dims.MEMBERSHIP_LISTS
    lists = F.array_compact(F.array(
        F.when(F.col("pos") % 3 == 0, F.lit(first)),
        F.when(F.col("pos") % 2 == 0, F.lit(second)),
        F.when((F.col("pos") % 3 != 0) | (F.col("pos") % 5 == 0), F.lit(third)),
    ))
    return base.select(
        "ticker", "pos", F.explode(lists).alias("list"), F.concat("s_name", F.lit("@"), F.col("list")).alias("name")
    )


def instruments(spark: SparkSession) -> DataFrame:
    ranges = [(k, *SERIES_RANGE.get(k, DEFAULT_RANGE)) for _, k, *_ in dims.instrument_rows()]
    spans = dims.literal_frame(spark, ranges, "key string, base double, span double")
    return dims.instruments(spark).join(spans, "key")


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, dt, close): order lines spread over the instruments by part key."""
    count = len(dims.instrument_rows())
    last = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_partkey") % count).cast("int").alias("symbol_no"), F.to_date("l_shipdate").alias("dt"))
        .agg(F.max_by(F.col("l_extendedprice") / F.col("l_quantity"),
                      F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("price"))
    )
    spans = instruments(spark).select("symbol_no", "symbol", "base", "span")
    return last.join(spans, "symbol_no").select(
        "symbol", "dt", rnd(F.col("base") + F.col("price") % F.col("span"), 4).alias("close")
    )


def macro_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, line): `date,value` text as a macro file holds it; `.` marks a missing day."""
    series = F.create_map(*[F.lit(x) for kv in MACRO_EVENTS.items() for x in kv])
    daily = (
        table(spark, sf_dir, "events")
        .groupBy("event_type", F.to_date("ts").alias("dt")).agg(F.sum("value").alias("total"))
        .select(series[F.col("event_type")].alias("series"), "dt", rnd(F.col("total"), 2).alias("total"))
    )
    value = F.when(F.dayofmonth("dt") % 7 == 0, ".").otherwise(
        F.when(F.col("series") == "nfci", rnd(F.col("total") % 2 - 1, 3)).otherwise(F.col("total")).cast("string")
    )
    return daily.select("series", F.concat_ws(",", F.date_format("dt", "yyyy-MM-dd"), value).alias("line"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote-page fields by ticker, worked out from customer balances."""
    bal, key = F.col("c_acctbal"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        ticker_of(key).alias("ticker"),
        rnd(bal / 1000, 4).alias("trailing_eps"),
        rnd(bal / 900, 4).alias("forward_eps"),
        F.when(key % 7 != 0, rnd((bal + key % 500) / 950, 4)).alias("eps_next_yr"),
        F.when(key % 11 != 0, rnd(bal * 3, 4)).alias("free_cashflow"),
        rnd(F.abs(bal) * 10 + key % 50, 4).alias("total_revenue"),
        F.when(key % 5 != 0, rnd(bal / 40000, 4)).alias("roe"),
        F.when(key % 25 != 0, rnd(bal / 80000, 4)).alias("roa"),
        rnd(bal / 30000, 4).alias("op_margin"),
        rnd(bal / 15000, 4).alias("gross_margin"),
        F.when(key % 13 != 0, rnd(bal / 50000 - 0.05, 4)).alias("rev_growth"),
        rnd(F.abs(bal) / 300, 4).alias("pe"),
        F.when(key % 4 != 0, rnd(F.abs(bal) / 3000, 4)).alias("div_yield"),
        rnd(F.lit(0.5) + (key % 12) / 10.0, 4).alias("beta"),
        rnd((key % 60) * 1.0, 4).alias("market_cap_b"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines by period: order status picks the line item."""
    status = F.col("o_orderstatus")
    item = (
        F.when(status == "F", "Operating Income").when(status == "O", "Invested Capital")
        .otherwise("Tax Rate For Calcs")
    )
    value = F.when(status == "P", rnd((F.col("o_totalprice") % 40) / 100, 4)).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        ticker_of(F.col("o_custkey")).alias("ticker"), item.alias("line_item"),
        F.to_date("o_orderdate").alias("period_end"), F.col("o_orderkey").alias("seq"), value.alias("value"),
    )


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("U"), F.col("l_linestatus")).alias("underlying"),
        F.last_day(F.to_date("l_shipdate")).alias("expiry"),
        F.when(F.col("l_returnflag") == "R", "put").otherwise("call").alias("side"),
        F.col("l_extendedprice").alias("strike"),
        F.when(F.col("l_discount") != 0.05, F.col("l_quantity")).alias("volume"),
    )


def earnings_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        ticker_of(F.col("o_custkey")).alias("ticker"), F.to_date("o_orderdate").alias("report_date"),
        (F.col("o_orderkey") % 24).cast("int").alias("hour"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, feed_pos, max_items, max_age_h, longform): one row per document source."""
    number = F.regexp_extract("feed", r"(\d+)$", 1).cast("int")
    return (
        table(spark, sf_dir, "documents").select(F.col("source").alias("feed")).distinct()
        .withColumn("feed_pos", number)
        .select(
            "feed", "feed_pos",
            (F.col("feed_pos") % 13 + 6).alias("max_items"),
            F.element_at(F.array(*[F.lit(h) for h in (24, 48, 72, 168)]), F.col("feed_pos") % 4 + 1).alias("max_age_h"),
            (F.col("feed_pos") % 5 == 0).alias("longform"),
        )
    )


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news_entries(table(spark, sf_dir, "documents"))


def news_entries(documents: DataFrame) -> DataFrame:
    """Feed entries: first line as title, whole text as summary, ten minutes apart."""
    key = F.col("doc_id")
    headline = F.trim(F.substring_index("text", "\n", 1))
    inner = F.when(key % 3 == 0, F.concat(F.lit("Wire "), (key % 7).cast("string")))
    title = (
        F.when(key % 101 == 0, F.lit("")).when(key % 29 == 0, F.concat(F.lit("Podcast: "), headline))
        .when(key % 3 == 0, F.concat(headline, F.lit(" - "), inner)).otherwise(headline)
    )
    published = F.to_timestamp_ntz(F.lit(NEWS_EPOCH)) + F.make_dt_interval(mins=(key * 10).cast("int"))
    return documents.select(
        F.col("source").alias("feed"), key.alias("pos"), title.alias("title"), F.col("text").alias("summary"),
        F.concat(F.lit("https://example.com/"), key).alias("link"), inner.alias("inner_source"),
        F.when(key % 17 != 0, published).alias("published"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names drawn from the long words of the benchmark texts, with made-up grades."""
    words = (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("word"))
        .groupBy(F.upper("word").alias("base")).agg(F.min("word").alias("word"))
    )
    size = F.length("word")
    return words.select(
        F.concat("base", F.lit(".X")).alias("ticker"),
        F.when(size % 3 == 0, F.concat("word", F.lit(" Inc"))).otherwise(F.col("word")).alias("name"),
        F.element_at(F.array(*[F.lit(g) for g in dims.GRADES]), size % 4 + 1).alias("grade"),
        (size % 5).alias("pass_count"),
        F.when(size % 2 == 0, F.array(F.concat(F.col("word"), F.lit(" of"))))
        .otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.col("base").alias("pos"),
    )


# Sentences that the cleaning rules look for.
BODY_TAILS = ["台積電股價大漲 5%。", "芯片数据合约公布；汇率持穩。", "NVDA 收高 3.2%；產能滿載。", "CPI 年增漲 3%。", ""]
HEAD_TAILS = {3: " 費半大跌 4%", 11: " 營收大漲 20%，股價漲 5%"}


def news_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified items: block, region and date worked out from the document key."""
    key = F.col("doc_id")
    blocks = dims.NEWS_BLOCKS + [dims.REGIONAL_BLOCK] + dims.CLEAN_ONLY_BLOCKS
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    block = pick(blocks, key % len(blocks))
    source_date = F.date_format(F.date_add(F.lit("2024-05-20").cast("date"), (key % 20).cast("int")), "yyyy-MM-dd")
    head = F.trim(F.substring_index("text", "\n", 1))
    head_tail = F.when(key % 19 == 3, HEAD_TAILS[3]).when(key % 19 == 11, HEAD_TAILS[11]).otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.date_add(F.lit("2024-06-03").cast("date"), (key % 4).cast("int")).alias("as_of"),
        block.alias("block"),
        F.when(block == dims.REGIONAL_BLOCK, pick(dims.NEWS_REGIONS, key % 7)).alias("region"),
        key.alias("pos"), F.concat(head, head_tail).alias("headline"),
        F.concat("text", pick(BODY_TAILS, key % 5)).alias("body"),
        F.col("source"), F.when(key % 23 == 0, "n/a").otherwise(source_date).alias("source_date"),
        F.when(key % 3 == 0, "high").otherwise("medium").alias("importance"),
    )


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per session of the volatility index, with falsifiers around its own reading."""
    vix = closes(spark, sf_dir).filter(F.col("symbol") == "^VIX")
    falsifiers = F.array(
        F.struct(F.lit("^VIX").alias("metric"), F.lit(">").alias("op"), rnd(F.col("close") + 1, 2).alias("threshold"),
                 F.lit("波動上升").alias("meaning")),
        F.struct(F.lit("HYG").alias("metric"), F.lit("<").alias("op"), F.lit(78.0).alias("threshold"),
                 F.lit("信用轉弱").alias("meaning")),
    )
    return vix.select(
        F.col("dt").alias("as_of"), F.when(F.col("close") < 20, "偏多").otherwise("偏空").alias("call"),
        F.lit("中").alias("confidence"), falsifiers.alias("falsifiers"),
    )


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies around the event properties: fenced, trailing comma, missing comma, cut short; then strings that
    hold what a mending of commas looks for: in a clean reply, in one with both faults, with a line feed (no reply can be
    read that has one), and before a remark with braces."""
    body = F.col("props")
    inner = F.substring(body, F.lit(2), F.length(body))
    fields = F.rtrim(F.substring_index(inner, "}", 1))
    odd = r'"tag": "a ,] b ,} \" }"'
    kinds = [
        F.concat(F.lit("```json\n"), body, F.lit("\n```")),
        F.concat(F.lit("Here it is: {\"tag\": \"x\","), fields, F.lit(",}")),
        F.concat(F.lit("{\"tag\": \"y\"\n"), inner),
        F.substring(body, 1, 4),
        F.concat(F.lit("{" + odd + ", "), inner),
        F.concat(F.lit("{" + odd + "\n"), fields, F.lit(", }")),
        F.concat(F.lit("{\"tag\": \"two\nlines\", "), inner),
        F.concat(F.lit("```json\n{" + odd + "\n"), fields, F.lit(",\n}\n```\nas {agreed}")),
    ]
    wrapped = F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), wrapped.alias("text"))


def theme_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(as_of, theme, at, text): a weekly theme reply for each event."""
    names = F.array(*map(F.lit, dims.THEMES))
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("as_of"), F.element_at(names, (F.col("user_id") % len(dims.THEMES) + 1).cast("int")).alias("theme"))
    return raw_replies(spark, sf_dir).join(events, "id").select("as_of", "theme", F.col("id").alias("at"), "text")
