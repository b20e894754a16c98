"""Packing of documents into training sequences by order-preserving dynamic programming.

Each document becomes token ids with an end id behind them, and the documents of a task make one stream in table order.
The stream is cut into windows of at most `room` ids. A window may end behind a document (free), behind a sentence
(`SENTENCE` ids of penalty) or, in stretches without either, behind any 64th id (`PLACE`); it is padded to `room` unless
its size is a power of two, and `SEQUENCE` keeps short windows from being made for a few pad ids. The least sum of
padding and penalties is

    f(j) = penalty(j) + SEQUENCE + min( room - at(j) + min_i [f(i) + at(i)],  f(i) where at(j) - at(i) is a power of two )

over the cuts i within `room` of j. The inner minimum slides with j, so a monotone queue gives it in constant time; the
second term needs a lookup for each power.

Nothing is shuffled: a task packs what it reads, in segments of `SEGMENT` ids. Behind the last segment every id of the
final two windows is a possible cut, so that a task's rest is dealt to powers of two in place of one padded window. All
but the last two windows of a segment are final; their ids open the next one. A task holds one segment and the run of
whole texts in hand, however long its share is; a task that is run again on the same split makes the same sequences.
For a fixed order whatever the splits, `by` names columns to range-partition and sort by first.

Defined cases: null and empty texts hold the end id only; null ids and repeated rows are packed like others; no rows
make no sequences; other columns of the input are ignored. Ids are those of the tokenizers library (see `tokenfile`).
`sequence_id` is the task's number times 2**40 plus the sequence's number within it: unique and rising along the table,
with gaps between tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import textkit, tokenfile

ROOM = 2048
END = 1
SENTENCE, PLACE, SEQUENCE = 8, 48, 4
SEGMENT = 1 << 20
#: A stretch without a document or sentence end longer than GAP gets cuts every STRIDE ids.
GAP, STRIDE = 512, 64
_FREE = -1
#: What ends a sentence, and what may still stand behind that.
STOPS, CLOSERS = ".!?…。！？", "\"'”’»)]"

@lru_cache(maxsize=2)
def _marks(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By id: the piece ends in a sentence's end; in a line's end; begins with white space."""
    tokenizer = tokenfile._table(path).tokenizer
    texts = [tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size())]
    stop = np.array([t.rstrip(CLOSERS)[-1:] != "" and t.rstrip(CLOSERS)[-1] in STOPS for t in texts])
    return stop, np.array([t.endswith("\n") for t in texts]), np.array([t[:1].isspace() for t in texts])


def sentence_ends(ids: np.ndarray, path: str) -> np.ndarray:
    """Places behind sentences and lines: a stop before white space, or a line's end."""
    stop, line, blank = _marks(path)
    ends = line[ids]
    ends[:-1] |= stop[ids[:-1]] & blank[ids[1:]]
    return np.flatnonzero(ends) + 1


def cuts(doc_ends: np.ndarray, sentences: np.ndarray, every_from: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts of a stream that begins at 0 and ends with the last document end, and their penalties. From
    `every_from` on each place is one."""
    end = int(doc_ends[-1])
    weight = np.zeros(end + 1, np.int16)
    weight[sentences], weight[doc_ends], weight[0] = SENTENCE, _FREE, _FREE
    natural = np.flatnonzero(weight)
    for k in np.flatnonzero(np.diff(natural) > GAP):
        weight[natural[k] + STRIDE : natural[k + 1] : STRIDE] = PLACE
    if every_from is not None:
        rest = weight[max(every_from, 0) :]
        rest[rest == 0] = PLACE
    at = np.flatnonzero(weight)
    return at, np.maximum(weight[at], 0).astype(np.int64)


def plan(at: np.ndarray, penalty: np.ndarray, room: int = ROOM) -> tuple[list[int], int]:
    """The cuts (as numbers in `at`, first and last with them) of least cost, and that cost. Of equal costs the longer
    window wins. Neighbouring places must be at most `room` apart."""
    powers = [1 << k for k in range(room.bit_length()) if 1 << k <= room]
    late, early = [], []
    number = np.full(int(at[-1]) + 1, -1, np.int32)
    number[at] = np.arange(len(at))
    for p in powers:
        begin = int(np.searchsorted(at, p))
        i = number[at[begin:] - p]
        hit = np.flatnonzero(i >= 0)
        late.append(hit + begin)
        early.append(i[hit])
    late, early = np.concatenate(late), np.concatenate(early)
    order = np.lexsort((early, late))
    first = np.searchsorted(late[order], np.arange(len(at) + 1)).tolist()
    exact, place, extra = early[order].tolist(), at.tolist(), (penalty + SEQUENCE).tolist()
    count = len(place)
    cost, back = [0] * count, [0] * count
    # The queue's cuts are those between head and tail, their sums rising.
    queue, sums, head, tail, k = [0] * count, [0] * count, 0, 0, 0
    for j in range(1, count):
        here = place[j]
        edge = here - room
        while place[queue[head]] < edge:
            head += 1
        least, source, until = sums[head] - edge, queue[head], first[j + 1]
        while k < until:
            i = exact[k]
            k += 1
            if cost[i] <= least and (cost[i] < least or i < source):
                least, source = cost[i], i
        least += extra[j]
        cost[j], back[j] = least, source
        least += here
        while tail >= head and sums[tail] > least:
            tail -= 1
        tail += 1
        queue[tail], sums[tail] = j, least
    found = [len(place) - 1]
    while found[-1]:
        found.append(back[found[-1]])
    return found[::-1], cost[-1]


@dataclass
class Windows:
    """Finished windows in a row: their ids, ends and number so far, and the pieces of documents in them."""

    ids: np.ndarray
    ends: np.ndarray
    number: int
    doc: pa.Array
    start: np.ndarray
    length: np.ndarray
    doc_tokens: np.ndarray
    window: np.ndarray
    offset: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """Where each piece begins in `ids`."""
        return np.cumsum(self.length) - self.length


class Packer:
    """A stream of documents on its way into windows. `ids` from `done` on wait; so do the documents that reach there."""

    def __init__(self, path: str, room: int, segment: int):
        self.path, self.room, self.segment = path, room, segment
        self.ids = np.zeros(0, np.int32)
        self.ends, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.docs: pa.Array | None = None
        self.number = 0

    def add(self, docs: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> Iterator[Windows]:
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(sizes)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.docs = docs if self.docs is None else pa.concat_arrays([self.docs, docs])
        self.ids = np.concatenate([self.ids, ids])
        while len(self.ids) >= self.segment:
            yield self._pack(min(len(self.ids), 2 * self.segment), last=False)

    def finish(self) -> Iterator[Windows]:
        if len(self.ids):
            yield self._pack(len(self.ids), last=True)

    def _pack(self, size: int, last: bool) -> Windows:
        ids = self.ids[:size]
        ends = np.append(self.ends[self.ends < size], size)
        at, penalty = cuts(ends, sentence_ends(ids, self.path), size - 2 * self.room if last else None)
        chosen = at[plan(at, penalty, self.room)[0]]
        if not last:
            chosen = chosen[:-2]
        until = int(chosen[-1])
        inner = self.ends[self.ends <= until]
        edge = np.zeros(until + 1, bool)
        edge[chosen] = edge[inner] = True
        edges = np.flatnonzero(edge)
        firsts = edges[:-1]
        doc, window = np.searchsorted(self.ends, firsts, "right"), np.searchsorted(chosen, firsts, "right") - 1
        out = Windows(
            ids[:until], chosen[1:], self.number, self.docs.take(pa.array(doc)), firsts - (self.ends - self.sizes)[doc],
            np.diff(edges), self.sizes[doc], window, firsts - chosen[window])
        self.number += len(chosen) - 1
        self.ids, rest = self.ids[until:].copy(), len(inner)
        self.ends, self.sizes, self.docs = self.ends[rest:] - until, self.sizes[rest:], self.docs.slice(rest)
        return out


def _windows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, room: int, segment: int) -> Iterator[Windows]:
    table, packer = tokenfile._table(path), Packer(path, room, segment)
    for batch in batches:
        for first, end, raw, offsets in textkit.slabs(batch.column(1)):
            yield from packer.add(batch.column(0).slice(first, end - first), *table.encode(raw, offsets, [end_id]))
    yield from packer.finish()


def _source(docs: DataFrame, id_col: str, text_col: str, by: list[str] | None, room: int, segment: int) -> tuple[DataFrame, T.DataType]:
    if room < GAP or segment < 4 * room:
        raise ValueError(f"sequences need room for {GAP} ids, segments for four sequences")
    if by:
        docs = docs.repartitionByRange(*by).sortWithinPartitions(*by)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), docs.schema[id_col].dataType


def _first_id() -> int:
    return TaskContext.get().partitionId() << 40


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text",
         by: list[str] | None = None, room: int = ROOM, segment: int = SEGMENT) -> DataFrame:
    """One row a sequence: sequence_id, ids, size (with the padding that is still to be put behind them), and pieces
    (doc_id, start in the document, length, offset in the sequence, doc_tokens)."""
    source, kind = _source(docs, id_col, text_col, by, room, segment)
    piece = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "offset", "doc_tokens"))])
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("size", T.LongType()), T.StructField("pieces", T.ArrayType(piece))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _windows(batches, tokenizer_path, end_id, room, segment):
            n = len(w.ends)
            sizes = np.diff(w.ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, w.ends), pa.int32()), pa.array(w.ids, pa.int32()))
            fields = pa.StructArray.from_arrays(
                [w.doc, *(pa.array(x, pa.int64()) for x in (w.start, w.length, w.offset, w.doc_tokens))], names=piece.names)
            pieces = pa.ListArray.from_arrays(pa.array(np.searchsorted(w.window, np.arange(n + 1)), pa.int32()), fields)
            padded = np.where(sizes & (sizes - 1) == 0, sizes, room)
            numbers = _first_id() + w.number + np.arange(n)
            whole = pa.RecordBatch.from_arrays([pa.array(numbers), lists, pa.array(padded, pa.int64()), pieces], names=schema.names)
            for k in range(0, n, 256):
                yield whole.slice(k, 256)

    return source.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, tokenizer_path: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text",
                  by: list[str] | None = None, room: int = ROOM, segment: int = SEGMENT) -> DataFrame:
    """One row a piece of the sequences that `pack` makes, with the unsigned CRC-32 of its ids as little-endian unsigned
    32-bit integers, without moving ids out of the task that makes them."""
    source, kind = _source(docs, id_col, text_col, by, room, segment)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _windows(batches, tokenizer_path, end_id, room, segment):
            raw = memoryview(np.ascontiguousarray(w.ids, "<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(w.firsts.tolist(), w.length.tolist())]
            columns = [w.start, w.length, np.array(sums, np.int64), w.doc_tokens, _first_id() + w.number + w.window, w.offset]
            yield pa.RecordBatch.from_arrays([w.doc, *(pa.array(x, pa.int64()) for x in columns)], names=schema.names)

    return source.mapInArrow(run, schema)


def padding(sequences: DataFrame) -> DataFrame:
    """One row: sequences, ids in them and pad ids."""
    n = F.size("ids").cast("long")
    return sequences.agg(F.count("*").alias("sequences"), F.sum(n).alias("ids"), F.sum(F.col("size") - n).alias("padding"))
