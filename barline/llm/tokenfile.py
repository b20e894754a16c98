"""Token ids in Parquet list columns, in document order, for selective reads.

Documents are range-partitioned and sorted by id (then by a hash of the text, so that one id with very many texts still
spreads), tokenized, an end id is appended, and each partition becomes one file: `ids` dictionary-encoded, whole-number
columns delta-encoded, row groups and pages of a set size, with page indexes. Files carry positions within their
partition; the start in the whole sequence is added on reading from one sum per file, so no task counts all rows.

The ids are those of the tokenizers library. A byte-level pre-tokenizer never lets a piece cross a space between two
other characters from its left, nor the seam between an ASCII letter and a sign, so texts are cut there, and each task
keeps a bounded table of the distinct chunks (`chunktable`), each encoded once by the library. A lost executor repeats
its own partitions.

Defined cases: null ids come first; null or empty texts hold the end id only; repeated rows are all kept. Other columns
of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm import chunktable, textkit
from barline.session import shuffle_partitions

TOGETHER = 1000
LAYOUT = {
    "parquet.writer.version": "v2", "parquet.block.size": str(16 << 20), "parquet.page.size": str(128 << 10),
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "compression": "zstd",
}
SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


_BYTES = np.arange(256)
#: ASCII white space, with the separators that some rules count as such.
BLANK = ((_BYTES >= 9) & (_BYTES <= 13)) | ((_BYTES >= 28) & (_BYTES <= 32))
#: First bytes of the characters beyond ASCII that may be white space.
WIDE = np.isin(_BYTES, [0xC2, 0xE1, 0xE2, 0xE3])
LETTER = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
#: No bar: added tokens may hold one behind a letter, and are found in a text before it is parted.
SIGN = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~LETTER & ~DIGIT & (_BYTES != 0x7C)


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: texts that are not empty; spaces that surely stand between two characters other than white
    space inside a text; and seams that a byte-level pre-tokenizer always parts: behind an ASCII letter before a sign,
    digit or line end, behind a sign before a line end, and behind a single line end before a letter. Words then do not
    multiply with the signs behind them."""
    at = np.flatnonzero(raw == 32)
    before = [raw[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    after = raw[np.minimum(at + 1, len(raw) - 1)]
    wide = (before[0] >= 0x80) & ((before[1] == 0xC2) | (WIDE[before[2]] & (before[2] != 0xC2)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    inside = ~BLANK[before[0]] & ~wide & ~BLANK[after] & ~WIDE[after] & ~edge[at] & ~edge[at + 1]
    edge[at[inside]] = True
    if len(raw) > 2:
        letter, line = LETTER[raw], raw == 10
        seen = letter | SIGN[raw]
        edge[1:-1] |= (letter[:-1] & (SIGN | DIGIT)[raw[1:]]) | (seen[:-1] & line[1:])
        edge[2:-1] |= seen[:-2] & line[1:-1] & letter[2:]
    return np.flatnonzero(edge[:-1])


class ChunkTable(chunktable.ChunkTable):
    """Ids of distinct chunks from the tokenizers library."""

    def __init__(self, path: str):
        # One thread a worker: Spark fills the cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # A byte-level vocabulary writes a leading space as this letter.
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())])
        names = [np.frombuffer(t.content.encode(), np.uint8) for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(len(cuts(x, np.array([0, len(x)]))) > 1 for x in names):
            raise ValueError("an added token would be cut")

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return cuts(raw, offsets)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def segment(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of each chunk. Words behind a space go to the library many at once: each begins with a spaced piece."""
        chunks = [c.decode() for c in chunks]
        out: list[np.ndarray | None] = [None] * len(chunks)
        words = [k for k, c in enumerate(chunks) if c[0] == " " and " " not in c[1:] and len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, self._library(["".join(chunks[k] for k in g) for g in groups])):
            at = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            if len(at) == len(group) + 1:
                for k, i, j in zip(group, at[:-1].tolist(), at[1:].tolist()):
                    out[k] = ids[i:j]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self._library([chunks[k] for k in rest])):
            out[k] = ids
        return out


@lru_cache(maxsize=1)
def _table(path: str) -> ChunkTable:
    """The worker's table: tasks that share a worker process share it."""
    return ChunkTable(path)


def _rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, at = _table(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, end, raw, offsets in textkit.slabs(batch.column(1)):
                ids, n = table.encode(raw, offsets, [end_id])
                places = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.full(len(n), part, np.int32)), pa.array(at + places[:-1]), pa.array(n), lists],
                    names=["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(places[-1])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", files: int | None = None, layout: dict[str, str] | None = None) -> None:
    """Write the token files. `files` is by default the number of shuffle partitions."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    sorted_ = texts.repartitionByRange(files or shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    sorted_.mapInArrow(_rows(tokenizer_path, end_id), SCHEMA).write.options(**(LAYOUT | (layout or {}))).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The files as written: doc_id, part, at (place within the part), n_tokens, ids. A filter on doc_id skips row groups
    and pages."""
    return spark.read.schema(SCHEMA).parquet(folder)


def part_starts(tokens: DataFrame) -> DataFrame:
    """(part, first): ids in all earlier parts. One row for each file."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("first"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(offsets[:-1], offsets[1:])]
        counts = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), counts, pa.array(sums, pa.int64())],
                                         names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start in the whole sequence, n_tokens and CRC-32 of its ids."""
    tokens = read_tokens(spark, folder)
    rows = tokens.select("doc_id", "part", "at", "ids").mapInArrow(_checked, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(tokens), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
