"""Ranks and percentiles inside an as-of group of any size.

A plain window would put a whole as-of group into one task. Here a group is cut into slices of its value: an
order-preserving function of the value alone, so a recomputed task gets the same slices. Running sums go inside a
slice, and one row per slice carries the offset. A group has at most some ten thousand slices, whatever its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.session import work_folder


def written(df: DataFrame) -> DataFrame:
    """`df` as a table next to the checkpoints, for rows that are read twice: what made them is neither planned nor run
    again, each reading takes the columns it needs, and a lost executor costs a read."""
    folder = work_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slice_of(value: Column) -> Column:
    """A whole number that never falls as the value rises: fine around zero, in steps of 1.6 % far from it. Nulls come
    first, NaN last."""
    x = value.cast("double")
    return F.when(F.isnan(x), F.lit(1 << 31)).otherwise(
        F.coalesce(F.floor(F.signum(x) * F.log1p(F.least(F.abs(x), F.lit(1e300)) * 16) * 64), F.lit(-(1 << 31))))


def running_total(df: DataFrame, by: list[str], value: Column, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Add `out`, the running sum of positive weights in `order` within `by`. `order` must be unique and begin with
    `value`, rising."""
    inside = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    counted = df.withColumn("_slice", slice_of(value)).withColumn(out, F.sum(weight).over(inside))
    # The rows lie by (by, _slice) already: neither the sums nor the join move them again.
    sums = counted.groupBy(*by, "_slice").agg(F.max(out).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*by, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return counted.join(offsets, [*by, "_slice"]).withColumn(out, F.col(out) + F.col("_offset")).drop("_slice", "_offset")


def position(df: DataFrame, by: list[str], value: str, ties: list[str], out: str = "rank") -> DataFrame:
    """1..n by falling value (nulls last) within `by`, then by rising ties."""
    falling = -F.col(value)
    order = [F.col(value).desc_nulls_last(), *map(F.col, ties)]
    # Nulls come last here, so their slice must, too.
    keyed = F.coalesce(falling.cast("double"), F.lit(float("nan")))
    return running_total(written(df), by, keyed, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out).cast("int"))


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal, half up, in whole-number arithmetic."""
    return F.floor((part * 2000 + whole) / (whole * 2)) / 10


def value_ladder(values: DataFrame, by: list[str]) -> DataFrame:
    """(*by, value, upto, total) of (*by, value): how many values of the group are at or below each distinct one.

    One row per distinct value from the first shuffle on, so a value shared by a third of the rows is one row here.
    """
    levels = values.groupBy(*by, "value").agg(F.count("*").alias("n")).withColumn("_slice", slice_of(F.col("value")))
    inside = W.partitionBy(*by, "_slice").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    counted = levels.withColumn("upto", F.sum("n").over(inside))
    # One row per slice: its offset and, at the end of the running sum, the size of the whole group.
    sums = counted.groupBy(*by, "_slice").agg(F.max("upto").alias("_sum"))
    before, whole = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    offsets = sums.select(*by, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), F.sum("_sum").over(whole).alias("total"))
    return counted.join(offsets, [*by, "_slice"]).select(*by, "value", (F.col("upto") + F.col("_offset")).alias("upto"), "total")


def percents_at_or_below(df: DataFrame, by: list[str], columns: dict[str, str], key: list[str]) -> DataFrame:
    """For each value column: 100 * count(v <= value) / count(v) within `by` to one decimal.

    columns: value column to output column; null values get null and do not count. `by` and `key` name a row. All
    columns go through one ladder and one join: each row is there once a column, with its other fields in the first
    copy only, and the copies of a row are put together again by its name.
    """
    df, named = written(df), [*by, *key]
    rest = F.struct(*[c for c in df.columns if c not in named])
    copies = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(c).cast("double").alias("value"), F.when(F.lit(n) == 0, rest).alias("rest"))
        for n, c in enumerate(columns)])
    flat = df.select(*named, F.explode(copies).alias("c")).select(*named, "c.*")
    ladder = value_ladder(flat.filter("value IS NOT NULL").select(*by, "column", "value"), [*by, "column"])
    told = flat.join(ladder, [*by, "column", "value"], "left").withColumn("share", percent_of(F.col("upto"), F.col("total")))
    shares = [F.max(F.when(F.col("column") == n, F.col("share"))).alias(out) for n, out in enumerate(columns.values())]
    rows = told.groupBy(*named).agg(F.first("rest", ignorenulls=True).alias("rest"), *shares)
    return rows.select(*[F.col(c) if c in named else F.col("rest").getField(c).alias(c) for c in df.columns], *columns.values())


def percents_in_place(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """The same percents for groups that lie in one task each, as the rows of a session do: a sort a column there, which
    can spill, and nothing is moved, copied or written."""
    for value, out in columns.items():
        order = W.partitionBy(*by).orderBy(value)
        upto, total = F.count(value).over(order), F.count(value).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        df = df.withColumn(out, F.when(F.col(value).isNotNull(), percent_of(upto, total)))
    return df


def first_k(
    df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "pos"
) -> DataFrame:
    """The first `k` rows of each group. The literal bound lets Spark cut before the shuffle."""
    window = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def rank_delta(previous: Column, current: Column) -> Column:
    return previous - current


def rank_delta_label(delta: Column, has_history: Column | bool = True) -> Column:
    """`↑3`, `↓2`, `—` or `新進`; `—` for all when there is no earlier snapshot."""
    history = has_history if isinstance(has_history, Column) else F.lit(has_history)
    return (
        F.when(~history, "—").when(delta.isNull(), "新進")
        .when(delta > 0, F.concat(F.lit("↑"), delta.cast("string")))
        .when(delta < 0, F.concat(F.lit("↓"), (-delta).cast("string")))
        .otherwise("—")
    )
