"""Language identification by rank-order profiles.

Letters fall into 63 classes: a to z, and all others by a hash of their lower-case form. A profile is the `TOP` most
frequent n-grams (one to three classes, a blank at each end of a word) in order. A text goes to the language whose
profile is nearest by out-of-place distance: for each of the text's own `TOP` most frequent n-grams, how far its rank is
from the profile's, or `TOP` where the profile lacks it. The score is one minus the mean distance over `TOP`.

Counting goes over all labelled training texts: each task sums fixed-size count arrays, pieces of which are summed in a
shuffle, and only `TOP` rows a language reach the driver. Prediction is one pass without a shuffle over whole texts.
The labels must be languages, that is, of a number that a driver can hold `TOP` rows each of.

Whether a text is in any of the languages at all is asked of the learned texts themselves: by number of n-grams (powers of
two) a low quantile of their scores is taken, and a text that scores less than a fixed share of it is in none. In short
texts languages differ little, so only longer ones are told apart with certainty.

Defined cases: null texts and texts without a letter are `und` with score 0, as is any text when there is nothing to
learn from; a null id is never learned from; ties go to the first language by name. Columns of the input are kept, but
for such as are named like an added one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barline.llm import textkit
from barline.llm.store import PIECE, counter_rows, free_name, pack, saved, unpack

TOP = 300
UNKNOWN = "und"
#: A text is in none of the languages below this share of the score that all but so many of the learned texts reach.
SHARE, LOW = 0.6, 0.01
#: Learned texts that a number of n-grams needs for a bound, and the bound where there are fewer in all.
ENOUGH, REJECT = 20, 0.2
SLAB = 1 << 18
HELD_LANGS = 16
#: Codes of one, two and three letter classes, rounded up to whole pieces.
ONE, TWO, CODES = 64, 64 + 64 * 64, -(-(64 + 64**2 + 64**3) // PIECE) * PIECE


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point: 0 for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()[0]
            out[point] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 16) % 37
    return out


def grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slab: first text, n-gram codes, and where each text's codes begin and end."""
    for first, end, raw, offsets in textkit.slabs(texts, SLAB):
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        count = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bounds = count[offsets]  # in characters
        kinds = np.zeros(len(chars) + 2, np.int32)
        kinds[1:-1] = classes()[chars]
        before, after = kinds[:-2].copy(), kinds[2:].copy()
        inner = bounds[(bounds > 0) & (bounds < len(chars))]
        before[inner], after[inner - 1] = 0, 0
        at = np.flatnonzero(kinds[1:-1])
        mid, before, after = kinds[1:-1][at], before[at], after[at]
        codes = np.stack([mid, ONE + before * 64 + mid, TWO + (before * 64 + mid) * 64 + after, ONE + mid * 64], axis=1)
        use = np.ones(codes.shape, bool)
        use[:, 3] = after == 0
        letters = np.searchsorted(at, bounds)
        ends = 3 * letters + np.concatenate([[0], np.cumsum(use[:, 3])])[letters]
        yield first, codes[use], ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, piece, data) for lang, counts in sums.items() for piece, data in counter_rows(counts)]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                           pa.array([r[2] for r in rows], pa.binary())], names=["lang", "piece", "data"])

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, codes, ends in grams(batch.column(0)):
            parts: dict[str, list[np.ndarray]] = {}
            for k in range(len(ends) - 1):
                parts.setdefault(langs[first + k], []).append(codes[ends[k] : ends[k + 1]])
            for lang, some in parts.items():
                if lang not in sums:
                    if len(sums) >= HELD_LANGS:
                        yield out()
                    sums[lang] = np.zeros(CODES, np.int64)
                sums[lang] += np.bincount(np.concatenate(some), minlength=CODES)
    yield out()
    textkit.release()


def _sum(last: bool):
    """Sum the pieces of each (lang, piece), which arrive sorted; at last, give the TOP codes of each piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, np.zeros(PIECE, np.int64)

        def out() -> pd.DataFrame:
            if not last:
                return pd.DataFrame({"lang": [key[0]], "piece": [key[1]], "data": [pack(total)]})
            best = np.argsort(-total, kind="stable")[:TOP]
            best = best[total[best] > 0]
            return pd.DataFrame({"lang": key[0], "code": best + key[1] * PIECE, "n": total[best]})

        for batch in batches:
            for lang, piece, data in batch.itertuples(index=False):
                if (lang, piece) != key:
                    if key is not None:
                        yield out()
                    key, total = (lang, piece), np.zeros(PIECE, np.int64)
                total += unpack(data)
        if key is not None:
            yield out()

    return run


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, rank): the TOP n-grams of each language, over all rows with a text and a language."""
    texts = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    pieces = texts.mapInArrow(_count, "lang string, piece int, data binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    halves = pieces.repartition("lang", "piece", "salt").sortWithinPartitions("lang", "piece").drop("salt")
    halves = halves.mapInPandas(_sum(False), "lang string, piece int, data binary")
    whole = halves.repartition("lang", "piece").sortWithinPartitions("lang", "piece").mapInPandas(_sum(True), "lang string, code long, n long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return whole.withColumn("rank", rank - 1).where(F.col("rank") < TOP).select("lang", "code", "rank")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, code, rank in rows:
            self.ranks[number[lang], np.searchsorted(self.codes, code)] = rank

    def nearest(self, codes: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        codes = np.sort(codes)
        cuts = textkit.runs(codes)
        top = np.argsort(-np.diff(cuts), kind="stable")[:TOP]
        mine = codes[cuts[:-1]][top]
        at = np.searchsorted(self.codes, mine)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == mine, at, len(self.codes))
        theirs = self.ranks[:, at]
        apart = np.where(theirs < 0, TOP, np.abs(theirs - np.arange(len(mine)))).mean(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / TOP)


def identify(docs: DataFrame, known: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (columns `keep`, by default all) with lang_pred, score and n_grams; `known` comes from `profiles`."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score", "n_grams")]
    table = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in known.collect()]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, codes, ends in grams(batch.column(len(keep))):
                found += [(*table.value.nearest(codes[i:j]), int(j - i)) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.int64())], names=schema.names)
        textkit.release()

    return docs.select(*keep, docs[text_col].cast("string").alias(free_name(docs, "__text"))).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """One document in five, by its id, is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents that are not held out, then identify all. The profiles are written once."""
    known = saved(profiles(docs.where(~held_out(id_col)), text_col, lang_col), "profiles")
    return identify(docs, known, text_col, keep)


def _size() -> Column:
    """Number of n-grams as a power of two."""
    return F.floor(F.log2(F.greatest("n_grams", F.lit(1)))).cast("int")


def bounds(found: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> list[float]:
    """The least score of a text in some known language, for each size of `_size`; from the texts that `predict` learned
    from. One row a size comes to the driver."""
    learned = found.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.col("lang_pred") != UNKNOWN))
    # Scores are cut to thousandths, so that a percentile holds a fixed number of them.
    rows = learned.groupBy(_size().alias("size")).agg(F.percentile(F.round("score", 3), LOW).alias("low"), F.count("*").alias("n")).collect()
    low = {r["size"]: r["low"] for r in rows if r["n"] >= ENOUGH}
    if not low:
        return [REJECT] * 64
    near = [[low[k] for k in (size - 1, size, size + 1) if k in low] or low.values() for size in range(64)]
    return [SHARE * min(x) for x in near]


def accepted(found: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Rows of `predict`, which keeps id and language for it, that are in some known language."""
    bound = F.array(*(F.lit(x) for x in bounds(found, id_col, lang_col)))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.get(bound, _size())))
