"""Per-series operators. A series is one ticker or symbol ordered by day, so every window here
holds at most one row per trading day of one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import dates
from barline.functions.numeric import pct_change, ratio, rnd
from barline.session import shuffle_partitions
from barline.sources.dims import literal_frame

#: Bars looked back per horizon; "5 days" spans 4 bars, and so on.
HORIZONS = {"1w": 5, "4w": 21, "13w": 63}
#: Calendar days of history that a session looks back on: a name without a bar in them is gone.
PANEL_DAYS = 300
#: Calendar days whose rows are made in one task.
DAY_BLOCK = 8


def by_day(key: str):
    return W.partitionBy(key).orderBy("dt")


def newest_first(key: str):
    return W.partitionBy(key).orderBy(F.col("dt").desc())


def drop_missing(df: DataFrame, column: str = "close") -> DataFrame:
    """Each series drops its own missing rows, so "last N" means last N valid rows."""
    return df.dropna(subset=[column])  # nulls and NaN alike


def last_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The newest `n` rows of each series."""
    return df.withColumn("_rn", F.row_number().over(newest_first(key))).filter(F.col("_rn") <= n).drop("_rn")


def to_long(wide: DataFrame, field: str, key: str = "ticker") -> DataFrame:
    """A wide day-by-ticker panel as rows; missing cells are dropped."""
    names = [c for c in wide.columns if c != "dt"]
    return wide.unpivot(["dt"], names, key, field).filter(F.col(field).isNotNull())


def lookback_returns(df: DataFrame, key: str = "ticker") -> DataFrame:
    """ret_1w, ret_4w, ret_13w and the bar count so far; null where history is too short."""
    w = by_day(key)
    returns = {f"ret_{h}": pct_change(F.col("close"), F.lag("close", n - 1).over(w)) for h, n in HORIZONS.items()}
    return df.withColumns({**returns, "n_bars": F.row_number().over(w)})


def newest_alive(df: DataFrame, key: str, panel_days: int = PANEL_DAYS) -> DataFrame:
    """The newest row of each series that has one within `panel_days` of the newest day of all."""
    newest = last_rows(df, key, 1)
    edge = newest.agg(F.date_sub(F.max("dt"), panel_days).alias("_edge"))  # one row
    return newest.crossJoin(F.broadcast(edge)).filter(F.col("dt") >= F.col("_edge")).drop("_edge")


def carry_to_sessions(df: DataFrame, calendar: DataFrame, key: str, panel_days: int = PANEL_DAYS) -> DataFrame:
    """Every (series, session) with the newest row at or before it, not older than `panel_days`: an as-of fill.

    Each row covers the days up to the next row of its series, the end of its panel or the last session. These spans are
    moved, not the days in them: a span goes once to each `block` of `DAY_BLOCK` days it reaches, and days are made where
    it arrives. So the fill costs little more than the rows themselves, all rows of a session lie in one task, and a
    name that stopped trading makes no rows for ever.
    """
    edge = calendar.agg(F.min("as_of").alias("_first"), F.max("as_of").alias("_last"))
    until = F.date_sub(F.lead("dt").over(by_day(key)), 1)
    spans = df.withColumn("_until", until).crossJoin(F.broadcast(edge))  # one row
    until = F.least(F.coalesce("_until", "_last"), F.date_add("dt", panel_days))
    low, high = F.greatest("dt", "_first"), F.least(F.greatest(F.col("dt"), until), "_last")
    block = lambda day: F.floor(F.unix_date(day) / DAY_BLOCK).cast("int")
    reach = F.when(low <= high, F.sequence(block(low), block(high)))
    cut = spans.select("*", low.alias("_low"), high.alias("_high"), F.explode(reach).alias("block")).drop("_until", "_first", "_last")
    moved = cut.repartition(shuffle_partitions(df.sparkSession), "block")
    start = F.date_from_unix_date(F.col("block") * DAY_BLOCK)
    days = F.sequence(F.greatest("_low", start), F.least("_high", F.date_add(start, DAY_BLOCK - 1)))
    # The calendar has one row a trading day.
    return moved.withColumn("as_of", F.explode(days)).drop("_low", "_high").join(F.broadcast(calendar), "as_of")


def sessions(df: DataFrame) -> DataFrame:
    """Distinct trading days: one row per day, whatever the data size."""
    return df.select(F.col("dt").alias("as_of")).distinct()


def weekly(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Week bars (Monday start) of a close series."""
    return (
        df.groupBy(key, F.to_date(F.date_trunc("week", "dt")).alias("week"))
        .agg(F.max_by("close", "dt").alias("close"), F.max("dt").alias("last_dt"))
    )


def weekly_bars(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("ticker", F.to_date(F.date_trunc("week", "dt")).alias("week"))
        .agg(F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"))
    )


def true_range(df: DataFrame, key: str = "ticker") -> DataFrame:
    prev = F.lag("close").over(by_day(key))
    # greatest() skips nulls, so a first bar falls back to high - low.
    return df.withColumn(
        "tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    )


def tail_array(df: DataFrame, key: str, n: int, *fields: str, out: str = "tail") -> DataFrame:
    """One row per series: its newest `n` rows as an array, oldest first."""
    item = F.struct("dt", *fields)
    return last_rows(df, key, n).groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(out))


def last_two(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Latest and previous valid close per series with the latest day."""
    rows = df.withColumn("_rn", F.row_number().over(newest_first(key))).filter(F.col("_rn") <= 2)
    newest, before = F.col("_rn") == 1, F.col("_rn") == 2
    return rows.groupBy(key).agg(
        F.max(F.when(newest, F.col("dt"))).alias("data_date"),
        F.max(F.when(newest, F.col("close"))).alias("latest"),
        F.max(F.when(before, F.col("close"))).alias("previous"),
    )


# ---- array-shaped rules ----------------------------------------------------

def _three(values: Column) -> tuple[Column, Column, Column]:
    return tuple(F.try_element_at(values, F.lit(i)) for i in (-3, -2, -1))  # type: ignore[return-value]


def trend_of(values: Column, up: str, down: str, flat: str = "震盪", drift: str | None = None) -> Column:
    """Strict three-point trend; `drift` names an otherwise mixed series that ended lower."""
    a, b, c = _three(values)
    rule = F.when((c > b) & (b > a), up).when((c < b) & (b < a), down)
    if drift:
        rule = rule.when(c < a, drift)
    return rule.otherwise(flat)


def peak_of(values: Column) -> Column:
    """struct(ago, peak, decline_pct) of the first maximum; zeros for an empty array."""
    peak = F.array_max(values)
    last = F.try_element_at(values, F.lit(-1))
    drop = F.coalesce(ratio(peak - last, peak) * 100, F.lit(0.0))
    return F.struct(
        F.coalesce(F.size(values) - F.array_position(values, peak).cast("int"), F.lit(0)).alias("ago"),
        F.coalesce(peak, F.lit(0.0)).alias("peak"),
        rnd(drop, 1).alias("decline_pct"),
    )


def week_first_last(df: DataFrame, key: str = "symbol", calendar_year: bool = False) -> DataFrame:
    """First and last close of the newest week with at least two weekday closes.

    Without such a week: first and last of everything there is.
    """
    rows = df.filter(dates.is_weekday(F.col("dt")))
    week = rows.groupBy(key, dates.iso_week_key(F.col("dt"), calendar_year).alias("week")).agg(
        F.min("dt").alias("d0"), F.max("dt").alias("d1"),
        F.min_by("close", "dt").alias("c0"), F.max_by("close", "dt").alias("c1"), F.count("*").alias("n"),
    )
    full = F.when(F.col("n") >= 2, F.struct("week", "c0", "c1"))
    return week.groupBy(key).agg(
        F.max(full).alias("best"), F.min_by("c0", "d0").alias("all0"), F.max_by("c1", "d1").alias("all1"),
        F.max("d1").alias("data_date"),
    ).select(
        key, F.coalesce("best.c0", "all0").alias("first"), F.coalesce("best.c1", "all1").alias("last"), "data_date"
    )


def pairs(df: DataFrame, spec: dict[str, tuple[str, str]], on: str, key: str = "symbol") -> DataFrame:
    """(name, on, a, b) for every named pair of series, where both have a close.

    One scan and one aggregation serve all pairs, however many there are.
    """
    legs = [(name, side, symbol) for name, two in spec.items() for side, symbol in zip("ab", two)]
    uses = literal_frame(df.sparkSession, legs, f"name string, side string, {key} string")
    leg = lambda side: F.max(F.when(F.col("side") == side, F.col("close"))).alias(side)
    rows = df.join(F.broadcast(uses), key).groupBy("name", on).agg(leg("a"), leg("b"))  # uses: two rows per pair
    return rows.dropna(subset=["a", "b"])


def back_position(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows numbered from the end (1 = newest), the newest `n` only."""
    return df.withColumn("back", F.row_number().over(newest_first(key))).filter(F.col("back") <= n)
