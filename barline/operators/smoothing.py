"""Day-over-day smoothing with rounding at every step, as a fold over a name's snapshots.

Percentiles carry one decimal, so a step is exact integer arithmetic in tenths.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import shuffle_partitions

ALPHA_TENTHS = 2  # weight of the new value, in tenths
RAW = ["raw_1w", "raw_4w", "raw_13w"]
SMOOTH = ["rs_1w", "rs_4w", "rs_13w"]
BLOCK = 48
#: Sessions before the first wanted one from which the newest states are tried; each further try takes `WIDER` times as many.
WINDOW = 320
WIDER = 4
#: A share in tenths of a percent lies between these, and so does all that shares are smoothed to.
LEAST, MOST = 0, 1000


def tenths(value: Column) -> Column:
    return F.round(value * 10).cast("int")


def _step_tenths(previous: Column, raw: Column) -> Column:
    """(8 * previous + 2 * raw) / 10 half up; raw where there is no previous value."""
    mixed = F.floor((previous * (10 - ALPHA_TENTHS) + raw * ALPHA_TENTHS + 5) / 10).cast("int")
    return F.coalesce(mixed, raw)


def smooth_once(today: DataFrame, previous: DataFrame) -> DataFrame:
    """One daily step against the previous snapshot. Names absent from it start from raw."""
    prev = previous.filter(F.col("rs_1w").isNotNull()).select("ticker", *[F.col(c).alias(f"_{c}") for c in SMOOTH])
    steps = {s: _step_tenths(tenths(F.col(f"_{s}")), tenths(F.col(r))) / 10 for s, r in zip(SMOOTH, RAW)}
    return today.join(prev, "ticker", "left").withColumns(steps).drop(*[f"_{c}" for c in SMOOTH])


def smooth_history(rows: DataFrame, keep_last: int | None = None, carry: tuple[str, ...] = (), start: DataFrame | None = None) -> DataFrame:
    """Smooth whole histories: (ticker, seq, raw_*, carry) to (ticker, seq, rs_*, carry). `start` (ticker, seq, rs_*) is
    what earlier snapshots came to, in tenths, one row a name.

    `seq` numbers the snapshots without holes, so a jump in a name's seq means it was absent and
    starts over. A name's array holds one entry per snapshot. The fold runs in blocks, so that
    appending its output costs far less than one growing array would; `keep_last` keeps only
    each name's newest entries.
    """
    spark = rows.sparkSession
    raw = [tenths(F.col(c)).alias(c) for c in RAW]
    entry = F.struct(F.col("seq").cast("int").alias("seq"), *raw, *carry)
    # The fold is heavy for few bytes: a fixed partition count keeps it spread out.
    history = rows.repartition(shuffle_partitions(spark), "ticker").groupBy("ticker").agg(
        F.sort_array(F.collect_list(entry)).alias("rows")
    )
    state_type = "struct<seq:int,rs_1w:int,rs_4w:int,rs_13w:int>"

    def advance(done: Column, row: Column) -> Column:
        state = F.try_element_at(done, F.lit(-1))
        follows = state["seq"] == row["seq"] - 1
        following = F.struct(row["seq"].alias("seq"), *[
            _step_tenths(F.when(follows, state[s]), row[r]).alias(s) for s, r in zip(SMOOTH, RAW)])
        return F.concat(done, F.array(following))

    def advance_block(blocks: Column, start: Column) -> Column:
        last = F.slice(F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.array().cast(f"array<{state_type}>")), -1, 1)
        fresh = F.aggregate(F.slice("rows", start, BLOCK), last, advance)
        kept = F.slice(fresh, F.size(last) + 1, F.lit(BLOCK))
        return F.concat(blocks, F.array(kept))

    none = F.array().cast(f"array<array<{state_type}>>")
    if start is None:
        before = none
    else:
        held = F.struct(F.col("seq").cast("int").alias("seq"), *[F.col(c).cast("int").alias(c) for c in SMOOTH])
        history = history.join(start.select("ticker", F.array(F.array(held)).alias("_start")), "ticker", "left")
        before = F.coalesce("_start", none)
    starts = F.sequence(F.lit(1), F.size("rows"), F.lit(BLOCK))
    # The start, where there is one, is the first state: it goes again.
    states = F.flatten(F.aggregate(starts, before, advance_block))
    blocks = F.slice(states, F.size(states) - F.size("rows") + 1, F.size("rows")) if start is not None else states
    if keep_last is None:
        both = F.arrays_zip(F.col("blocks").alias("s"), F.col("rows").alias("r"))
    else:
        n = F.greatest(F.size("rows") - keep_last, F.lit(0)) + 1
        both = F.arrays_zip(F.slice("blocks", n, F.lit(keep_last)).alias("s"),
                            F.slice("rows", n, F.lit(keep_last)).alias("r"))
    folded = history.select("ticker", "rows", blocks.alias("blocks"))
    return folded.select("ticker", F.explode(both).alias("x")).select(
        "ticker", "x.s.seq", *[(F.col(f"x.s.{c}") / 10).alias(c) for c in SMOOTH], *[F.col(f"x.r.{c}") for c in carry]
    )


def smooth_newest(rows: DataFrame, as_of: list[date], before: int, carry: tuple[str, ...]) -> DataFrame:
    """The snapshots of `as_of` as `smooth_history` has them, from the rows of the snapshots behind number `before` alone:
    (ticker, seq, rs_*, carry, settled).

    A step never falls as the state before it rises, and a name that was absent goes on as if its state had been its own
    share. So the fold is done from the least and from the most that the state can be at `before`: where both come to the
    same, so does the true one, and the row is `settled`. Others need more rows. With `before` at 0 there is no state before.
    """
    raw = [tenths(F.col(c)).alias(c) for c in RAW]
    entry = F.struct(F.col("seq").cast("int").alias("seq"), *raw, *carry)
    history = rows.repartition(shuffle_partitions(rows.sparkSession), "ticker").groupBy("ticker").agg(
        F.sort_array(F.collect_list(entry)).alias("rows"))
    bounds = {"low": LEAST, "high": MOST}
    names = [f"{bound}_{s}" for bound in bounds for s in SMOOTH]
    state = F.struct(F.lit(before).alias("seq"), *[
        F.lit(value if before else None).cast("int").alias(f"{bound}_{s}") for bound, value in bounds.items() for s in SMOOTH])
    none = F.array().cast(f"array<struct<seq:int,{','.join(f'{n}:int' for n in names)}>>")
    is_wanted = lambda row: F.coalesce(row["as_of"].isin(as_of), F.lit(False))

    def advance(done: Column, row: Column) -> Column:
        follows = done["state"]["seq"] == row["seq"] - 1
        now = F.struct(row["seq"].alias("seq"), *[
            _step_tenths(F.when(follows, done["state"][n]), row[r]).alias(n) for n, r in zip(names, RAW * len(bounds))])
        return F.struct(now.alias("state"), F.when(is_wanted(row), F.concat(done["kept"], F.array(now))).otherwise(done["kept"]).alias("kept"))

    kept = F.aggregate("rows", F.struct(state.alias("state"), none.alias("kept")), advance)["kept"]
    both = F.arrays_zip(kept.alias("s"), F.filter("rows", is_wanted).alias("r"))
    settled = [F.col(f"x.s.low_{s}").eqNullSafe(F.col(f"x.s.high_{s}")) for s in SMOOTH]
    return history.select("ticker", F.explode(both).alias("x")).select(
        "ticker", "x.s.seq", *[(F.col(f"x.s.low_{s}") / 10).alias(s) for s in SMOOTH], *[F.col(f"x.r.{c}") for c in carry],
        (settled[0] & settled[1] & settled[2]).alias("settled"))


# ---- states that are kept ------------------------------------------------------------------------------------------

STATE = "ticker string, rs_1w int, rs_4w int, rs_13w int, seq int"


def write_states(states: DataFrame, folder: str, last: int) -> None:
    """Keep the states (ticker, seq, rs_*) of every `BLOCK`-th snapshot and of the one numbered `last`, in tenths, one
    folder a snapshot. Writing one again replaces it, so an interrupted or repeated run leaves the same table."""
    kept = states.filter((F.col("seq") % BLOCK == 0) | (F.col("seq") == last))
    rows = kept.select("ticker", *[tenths(F.col(c)).alias(c) for c in SMOOTH], F.col("seq").cast("int").alias("seq"))
    rows.repartition("seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seq").parquet(folder)


def states_before(spark: SparkSession, folder: str, seq: int) -> tuple[int, DataFrame]:
    """Number and rows of the newest kept snapshot before number `seq`; 0 and no rows where there is none. Snapshots are
    folders, so all but one are left out by name."""
    held = spark.read.schema(STATE).parquet(folder)
    found = held.filter(F.col("seq") < seq).agg(F.max("seq")).first()[0]
    return (found, held.filter(F.col("seq") == found)) if found is not None else (0, held.limit(0))
