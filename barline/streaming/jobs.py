"""Structured Streaming twins of the batch rules.

Stateful operators put all rows of a key into one task, so each job first thins its rows inside
the partitions they arrive in: a key that holds a third of the stream reaches the state as a
few rows per input batch. Keyed state lies in RocksDB, outside the heap of the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from barline.functions.dates import DESK_ZONE
from barline.functions.text import title_key
from barline.operators.smoothing import RAW, SMOOTH, tenths
from barline.session import work_folder
from barline.sources.readers import read_news_items


def read_files(spark: SparkSession, folder: str, schema, files: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of a table that is one Parquet file or a folder of them. A pattern that only this path matches lets a
    stream start at a file, too."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process everything there is, append to a Parquet table, return that table.

    With `folder`, its state and table are gone on with, so files of earlier runs are not taken again; else both are new.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark, name)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)  # a query keeps the store it was started with
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/state").start(f"{folder}/table")
        )
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


# ---- first title wins ------------------------------------------------------

def _first_per_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop_duplicates("title_key")


def dedup_titles(items: DataFrame, delay: str = "72 hours", max_age_hours: int | None = None) -> DataFrame:
    """Drop repeated titles within the watermark; undated items count from their arrival.

    With `max_age_hours`, dated items older than that at processing time are dropped first.
    """
    rows = items.withColumn("event_ts", F.coalesce("published", F.current_timestamp())).withColumn(
        "title_key", title_key(F.col("title")))
    if max_age_hours is not None:
        rows = rows.filter(F.col("event_ts") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(max_age_hours)))
    thinned = rows.mapInPandas(_first_per_key, rows.schema)
    return thinned.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["title_key"])


# ---- newest two closes per symbol ------------------------------------------

LATEST = "symbol string, latest_ts bigint, latest double, previous double, n_seen bigint"


def _two_newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = batch.groupby("symbol")["n"].transform("sum")
        top = batch.assign(n=counts).sort_values("ts").groupby("symbol").tail(2)
        # the count travels on one of the rows only
        top.loc[top.duplicated("symbol", keep="last"), "n"] = 0
        yield top


class LatestTwo(StatefulProcessor):
    """Keeps the newest two closes of a symbol and how many it has seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closes = handle.getListState("closes", "ts bigint, close double")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        kept = [(int(ts), float(c)) for ts, c in self.closes.get()]
        seen = (self.seen.get() or (0,))[0]
        for batch in rows:
            seen += int(batch["n"].sum())
            kept = sorted(kept + [(int(ts), float(c)) for ts, c in zip(batch["ts"], batch["close"])])[-2:]
        self.closes.put(kept)
        self.seen.update((seen,))
        previous = kept[0][1] if len(kept) == 2 else None
        yield pd.DataFrame({"symbol": [key[0]], "latest_ts": [kept[-1][0]], "latest": [kept[-1][1]],
                            "previous": pd.Series([previous], dtype="float64"), "n_seen": [seen]})

    def close(self) -> None:
        pass


def latest_two(closes: DataFrame) -> DataFrame:
    """(symbol, ts, close) stream to one row per symbol and trigger with its newest two closes.

    Rows without symbol, time or close count for nothing. States do not expire: those that live for a processing time
    would keep an available-now run from ending.
    """
    rows = closes.select("symbol", F.unix_micros("ts").alias("ts"), F.col("close").cast("double").alias("close"),
                         F.lit(1).cast("bigint").alias("n")).dropna()
    thinned = rows.mapInPandas(_two_newest, rows.schema)
    out = thinned.groupBy("symbol").transformWithStateInPandas(LatestTwo(), LATEST, "append", "None")
    return out.withColumn("latest_ts", F.timestamp_micros("latest_ts"))


def newest_state(table: DataFrame, key: str = "symbol", version: tuple[str, ...] = ("latest_ts", "n_seen")) -> DataFrame:
    """The last emitted row of each key."""
    others = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("s")).select(key, "s.*")


# ---- smoothed strength -----------------------------------------------------

SMOOTHED = "ticker string, seq bigint, rs_1w bigint, rs_4w bigint, rs_13w bigint, late bigint"
#: Names are dealt to this many states, by hash. A call of Python costs milliseconds, whatever it is for, so it
#: advances a state's names together; the number is part of a checkpoint.
BUCKETS = 1024
PACKED_ROWS = 1 << 16  # about 64 snapshots an array, so that a batch of rows stays small
PACKED = "bucket int, ticker array<string>, seq array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in RAW)


def _bucket(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def _packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row a bucket, its snapshots in arrays, in the order they came."""
    run = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    buckets = run.column("bucket").to_numpy()
    order = np.argsort(buckets, kind="stable")
    keys, firsts = np.unique(buckets[order], return_index=True)
    offsets = pa.array(np.append(firsts, len(order)), pa.int32())
    run = run.take(pa.array(order))
    names = ["ticker", "seq", *RAW]
    arrays = [pa.ListArray.from_arrays(offsets, run.column(c)) for c in names]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *arrays], names=["bucket", *names])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, size = [], 0
    for batch in batches:
        if batch.num_rows:
            run.append(batch)
            size += batch.num_rows
        if size >= PACKED_ROWS:
            yield _packed(run)
            run, size = [], 0
    if run:
        yield _packed(run)


def _fold(raws: np.ndarray, follows: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Smooth the snapshots (rows, in order of name and number) of names with `counts` rows each, all names a step at a
    time. A row that `follows` goes on from the row before it, or from `before`, what its name came to."""
    out = np.empty_like(raws)
    by = np.argsort(-counts, kind="stable")
    starts, counts, last = (np.cumsum(counts) - counts)[by], counts[by], before[by]
    for step in range(counts[0]):
        open_names = np.searchsorted(-counts, -step, side="left")
        rows = starts[:open_names] + step
        raw = raws[rows]
        last = np.where(follows[rows, None], (8 * last[:open_names] + 2 * raw + 5) // 10, raw)
        out[rows] = last
    return out


class SmoothState(StatefulProcessor):
    """Keeps the last smoothed snapshot of each name of a bucket, in tenths, and how many snapshots came too late for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", SMOOTHED)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        rows = initialState[["ticker", "seq", *SMOOTH]].itertuples(index=False)
        self.last.appendList([(name, *map(int, row), 0) for name, *row in rows])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # The snapshots of one bucket in one trigger, 40 bytes each: a trigger may bring them in any order.
        arrays = pd.concat(list(rows))
        column = lambda c: np.concatenate(arrays[c].to_list())
        held = {row[0]: tuple(row[1:]) for row in sorted(self.last.get(), key=lambda row: row[1])}
        name_of, names = pd.factorize(column("ticker"))
        none = (np.iinfo("int64").min, 0, 0, 0, 0)
        before = np.array([held.get(name, none) for name in names], "int64")
        seq, raws = column("seq").astype("int64"), np.stack([column(c) for c in RAW], axis=1).astype("int64")
        order = np.lexsort((seq, name_of))
        name_of, seq, raws = name_of[order], seq[order], raws[order]

        again = np.append(False, (name_of[1:] == name_of[:-1]) & (seq[1:] == seq[:-1]))
        late = again | (seq <= before[name_of, 0])  # they cannot change what was published
        n_late = np.cumsum(late)
        first = np.searchsorted(name_of, np.arange(len(names)))
        n_late += (before[:, 4] - n_late[first] + late[first])[name_of]

        name_of, seq, raws, seen = name_of[~late], seq[~late], raws[~late], n_late[~late]
        counts = np.bincount(name_of, minlength=len(names))
        previous = np.append(0, seq[:-1])[:len(seq)]
        begins = np.append(True, name_of[1:] != name_of[:-1])[:len(seq)]
        previous[begins] = before[name_of[begins], 0]
        smooth = _fold(raws, seq - 1 == previous, counts, before[:, 1:4])

        after = before.copy()
        some, ends = counts > 0, np.cumsum(counts) - 1
        after[some, 0], after[some, 1:4] = seq[ends[some]], smooth[ends[some]]
        after[:, 4] = n_late[np.append(first[1:], len(n_late)) - 1]
        held.update(zip(names, map(tuple, after.tolist())))
        self.last.put([(name, *row) for name, row in held.items()])
        yield pd.DataFrame({"ticker": names[name_of], "seq": seq, **{c: smooth[:, i] for i, c in enumerate(SMOOTH)}, "late": seen})

    def close(self) -> None:
        pass


def smooth_states(snapshots: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(ticker, seq, raw_*) stream to smoothed values; late snapshots are dropped, a gap restarts.

    `late` counts the name's snapshots dropped so far. `start` (ticker, seq, rs_* in tenths), as `smoothing.states_before`
    reads it, is what a new stream goes on from. Snapshots with a null count as absent.
    """
    rows = snapshots.select(_bucket(F.col("ticker")).alias("bucket"), "ticker", F.col("seq").cast("bigint").alias("seq"),
                            *[tenths(F.col(c)).cast("bigint").alias(c) for c in RAW]).dropna()
    held = None if start is None else start.filter("ticker IS NOT NULL").select(
        _bucket(F.col("ticker")).alias("bucket"), "ticker", *[F.col(c).cast("bigint").alias(c) for c in ("seq", *SMOOTH)]).groupBy("bucket")
    out = rows.mapInArrow(_pack, PACKED).groupBy("bucket").transformWithStateInPandas(SmoothState(), SMOOTHED, "append", "None", held)
    return out.select("ticker", "seq", *[(F.col(c) / 10).alias(c) for c in SMOOTH], "late")


# ---- tumbling bars ---------------------------------------------------------

def tumbling_bars(ticks: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(symbol, ts, seq, price, volume) ticks to bars; a bar appears once the watermark closes it."""
    order = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "symbol")
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume")
    )


# ---- schedule gate ---------------------------------------------------------

def is_run_day(day: Column, screen: bool = False) -> Column:
    """Desk-zone days with work: any but Sunday; the screen only Tuesday to Saturday."""
    return F.weekday(day).between(1, 5) if screen else F.weekday(day) != 6


def run_if_due(job: Callable[[], DataFrame], now: pd.Timestamp, screen: bool = False) -> DataFrame | None:
    """Run an available-now job on its days, else nothing. `now` is UTC."""
    weekday = now.tz_localize("UTC").tz_convert(DESK_ZONE).weekday()
    return job() if (1 <= weekday <= 5 if screen else weekday != 6) else None


def take_new_files(spark: SparkSession, source: str, folder: str, now: pd.Timestamp, screen: bool = False) -> DataFrame | None:
    """One gated run over a folder of news files: on a run day, append the items of files that no earlier run took to the
    table in `folder`, with the time of the run, and return that table. On other days nothing is read, and the files wait
    for the next run. `now` is UTC. A run that is lost goes on from the checkpoint and takes no file twice."""
    def job() -> DataFrame:
        items = read_news_items(spark, source, stream=True)
        return run_available(items.withColumn("run_at", F.lit(now.to_pydatetime())), "feed", folder)
    return run_if_due(job, now, screen)
