"""Written intermediate tables and fixed-size counters, shared by the operators of this package."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.session import work_folder

#: Counters in one row of a partial sketch.
PIECE = 4096


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write to the shared folder that spark.checkpoint.dir names, and read back: cuts the lineage for good."""
    folder = work_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pack(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype(np.int64).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def counter_rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The pieces of a counter array that hold anything, as (piece, packed numbers)."""
    pieces = counts.reshape(-1, PIECE)
    for k in np.flatnonzero(pieces.any(axis=1)):
        yield int(k), pack(pieces[k])


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, data in zip(batch["piece"], batch["data"]):
            sums.setdefault(piece, np.zeros(PIECE, np.int64))
            sums[piece] += unpack(data)
    yield pd.DataFrame({"piece": list(sums), "data": [pack(x) for x in sums.values()]})


def counter(parts: DataFrame, size: int) -> np.ndarray:
    """Sum partial counter pieces (piece, data) of all tasks. Two levels of sums, each streaming; the result has `size`
    numbers whatever the input, so it may come to the driver."""
    out = np.zeros((size // PIECE, PIECE), np.int64)
    schema = "piece int, data binary"
    halves = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    halves = halves.repartition("piece", "salt").select("piece", "data").mapInPandas(_add, schema)
    for piece, data in halves.repartition("piece").mapInPandas(_add, schema).toLocalIterator():
        out[piece] = unpack(data)
    return out.ravel()


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that are named like ones to be added, whatever their letter case."""
    return df.select(*(df[c] for c in df.columns if c.lower() not in {n.lower() for n in names}))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, where no added column can clash with them."""
    return df.select(*(df[c] for c in needed), F.struct(F.lit(0).alias("_"), *(df[c] for c in df.columns if c not in needed)).alias("__rest"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table that was packed."""
    return df.select(*(F.col(c) if c in df.columns and c not in df.schema["__rest"].dataType.names else F.col("__rest").getField(c).alias(c) for c in columns))
