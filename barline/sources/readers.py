"""Scans: files as the desks leave them, and the dimension rules that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline import schemas
from barline.operators.ranking import first_k
from barline.sources import dims


def read_bars(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Bars in Parquet, partitioned by dt; `since` prunes partitions."""
    bars = spark.read.schema(schemas.BARS).parquet(path)
    return bars.filter(F.col("dt") >= F.lit(since).cast("date")) if since else bars


def scan_closes(closes: DataFrame, instruments: DataFrame) -> DataFrame:
    """Valid closes of the listed symbols only."""
    return closes.filter(F.col("close").isNotNull()).join(instruments.select("symbol").distinct(), "symbol", "left_semi")


def read_macro_csv(spark: SparkSession, path: str, series: str) -> DataFrame:
    """A two-column macro file; `.` and blanks are missing, unreadable numbers too."""
    raw = spark.read.csv(path, schema=schemas.MACRO_FILE, header=True, nullValue=".")
    return raw.select(F.lit(series).alias("series"), F.col("dt").try_cast("date").alias("dt"),
                      F.col("value").try_cast("double").alias("value")).dropna()


def parse_macro_lines(lines: DataFrame) -> DataFrame:
    """(series, line) text rows to (series, dt, value)."""
    cells = F.split("line", ",")
    return lines.select(
        "series", F.get(cells, F.lit(0)).try_cast("date").alias("dt"), F.get(cells, F.lit(1)).try_cast("double").alias("value")
    ).dropna()


def parse_watch_sheet(sheet: DataFrame) -> DataFrame:
    """(pos, ticker, sector) sheet rows: blanks and repeated headers out, trimmed, first row of a
    ticker wins its place, the last its sector; at most five characters."""
    ticker = F.trim("ticker")
    rows = sheet.filter(F.col("ticker").isNotNull() & (F.col("ticker") != "") & (F.col("ticker") != "Ticker")).select(
        "pos", ticker.alias("ticker"), F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("Unknown")).alias("sector"))
    return rows.filter(F.length("ticker").between(1, 5)).groupBy("ticker").agg(
        F.min("pos").alias("pos"), F.max_by("sector", "pos").alias("sector"))


def read_watch_sheet(spark: SparkSession, path: str, skip: int = 3) -> DataFrame:
    """A CSV export of the watch-list sheet; the first `skip` lines are titles. One small file:
    line numbers come from the file's own order."""
    raw = spark.read.csv(path, schema=schemas.WATCH_SHEET).withColumn("pos", F.monotonically_increasing_id())
    return parse_watch_sheet(raw.filter(F.col("pos") >= skip))


def first_sector(members: DataFrame) -> DataFrame:
    """(sector_pos, sector, ticker): a ticker listed twice belongs to its first sector."""
    return members.groupBy("ticker").agg(F.min_by("sector", "sector_pos").alias("sector"))


def first_membership(members: DataFrame, precedence: list[str]) -> DataFrame:
    """One row per ticker from overlapping lists; the earlier list wins name and label."""
    order = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col("list"))
    return first_k(members.withColumn("_order", order), ["ticker"], [F.col("_order")], 1, out="_place").drop("_order", "_place")


def with_region(ranking: DataFrame) -> DataFrame:
    spec = dims.region_dim(ranking.sparkSession).select(F.col("market").alias("name"), "region")
    return ranking.join(spec, "name", "left").withColumn("region", F.coalesce("region", F.lit(dims.OTHER_REGION)))


def explode_watch_doc(docs: DataFrame) -> DataFrame:
    """Watch-list documents with a stocks array; blank tickers are dropped."""
    rows = docs.select(F.explode("stocks").alias("s")).select(
        F.trim("s.ticker").alias("ticker"), F.coalesce("s.name", F.lit("")).alias("name"),
        F.coalesce("s.moat_grade", F.lit("")).alias("grade"), F.col("s.pass_count").alias("pass_count"))
    return rows.filter(F.length("ticker") > 0)


def read_watch_doc(spark: SparkSession, path: str) -> DataFrame:
    return explode_watch_doc(spark.read.json(path, schema=schemas.WATCH_DOC, multiLine=True))


def read_snapshot_docs(spark: SparkSession, path: str) -> DataFrame:
    """Nested day documents to one row per ranked name."""
    docs = spark.read.json(path, schema=schemas.SNAPSHOT_DOC, multiLine=True)
    return docs.select(F.col("date").cast("date").alias("as_of"), F.explode("data").alias("d")).select("as_of", "d.*")


def read_news_items(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.NEWS_ITEM).json(path)


def read_theme_docs(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Theme documents as `sinks.write_documents` lays them out, with each theme's place; a document that does not fit
    `fields` fails the read."""
    docs = spark.read.schema(f"{fields}, as_of date, theme string").option("mode", "FAILFAST").json(path)
    places = F.create_map(*[F.lit(x) for pair in ((name, k) for k, name in enumerate(dims.THEMES, 1)) for x in pair])
    return docs.withColumn("pos", places[F.col("theme")])


def newest_before(snapshots: DataFrame, today: Column) -> DataFrame:
    """Rows of the newest snapshot before `today`."""
    earlier = snapshots.filter(F.col("as_of") < today)
    newest = earlier.agg(F.max("as_of").alias("as_of"))
    return earlier.join(F.broadcast(newest), "as_of", "left_semi")  # one row


def distinct_in_order(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with the place of their first occurrence."""
    return rows.groupBy(key).agg(F.min(pos).alias(pos))


def symbol_union(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("symbol")
    for frame in frames[1:]:
        out = out.union(frame.select("symbol"))
    return out.distinct()
