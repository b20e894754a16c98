"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of white-space markers with the word behind it. In a vocabulary where no piece has a marker after
another character, merges never cross a chunk's start, so a text's ids are its chunks' ids in order. The same holds at
any two ASCII characters that stand next to each other in no piece (a letter and the comma behind it), so words are
parted there as well and do not multiply with the signs around them. Each task keeps a table of the distinct chunks that
it meets (`chunktable`), segments each once with the library, and puts the ids back by position.

A table for all data at once would have to carry every (block, chunk) pair through two shuffles, more bytes than the
text. Nothing is shuffled, and a lost executor repeats its own tasks only.

Defined cases: null and empty texts have no ids and decode to the empty string. Markers that stand in the text itself
are treated as the library does, as white space. Columns of the input are kept, but for such as are named like an added
one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barline.llm import chunktable, textkit
from barline.llm.store import free_name, without

IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())
MARK = "▁"
#: Bytes of texts in hand at once. Workers go on to other stages, and what they once held stays with them.
SLAB = 1 << 20


@lru_cache(maxsize=4)
def processor(path: str):
    """The library's processor, checked for what the chunk table rests on."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    plain = not any(MARK in n.lstrip(MARK) for n in names)
    # No normalization but the marker: a probe with what the usual rules would change.
    probe = "  Ａ½  á​\t x \n"
    same = model.decode(model.encode(probe)) == probe
    if not (plain and same):
        raise ValueError("pieces may cross a white-space marker, or texts are normalized: chunks are not independent")
    return model


class ChunkTable(chunktable.ChunkTable):
    """Ids of distinct chunks. Each text is given a space in front, which the library puts there itself."""

    limit = 500_000

    def __init__(self, path: str):
        super().__init__()
        self.model = processor(path)
        n = self.model.vocab_size()
        plain = (self.model.id_to_piece(i) for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)))
        together = np.zeros((256, 256), bool)
        for name in plain:
            for a, b in zip(name.replace(MARK, " "), name[1:].replace(MARK, " ")):
                if a < "\x80" and b < "\x80":
                    together[ord(a), ord(b)] = True
        self.marker = self.model.piece_to_id(MARK)
        # A stretch without a marker in front is segmented behind a line end, with which nothing merges.
        self.head = len(self.model.encode("\n"))
        if together[10].any() or together[:, 10].any() or self.model.encode("\na")[: self.head] != self.model.encode("\n"):
            together[:, ord("!") :] = together[:, 10] = True
        self.apart = ~together
        self.apart[0x80:] = self.apart[:, 0x80:] = False
        self.strings = [str(i) for i in range(n)]

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(raw) + 1, bool)
        edge[1:-1] = self.apart[raw[:-1], raw[1:]]
        # Before a space behind a character beyond ASCII, unless that is a marker itself.
        at = np.flatnonzero(raw == 32)
        before = [raw[np.maximum(at - k, 0)] for k in (1, 2, 3)]
        edge[at[(before[0] >= 0x80) & ~((before[0] == 0x81) & (before[1] == 0x96) & (before[2] == 0xE2))]] = True
        edge[offsets] = True
        return np.flatnonzero(edge[:-1])

    def segment(self, chunks: list[bytes]) -> list[list[int]]:
        head = self.head
        texts = [c[1:].decode() if c[0] == 32 else "\n" + c.decode() for c in chunks]
        found = self.model.encode(texts, num_threads=1)
        return [[self.marker] if c == b" " else ids if c[0] == 32 else ids[head:] for c, ids in zip(chunks, found)]

    def slabs(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of whole texts: first text, end, their ids in a row and the offsets of each text's."""
        for first, end, raw, offsets in textkit.slabs(texts, SLAB):
            filled = offsets[1:] > offsets[:-1]
            raw = np.insert(raw, offsets[:-1][filled], 32)
            ids, n = self.encode(raw, offsets + np.append(0, np.cumsum(filled)), [])
            yield first, end, ids, np.append(0, np.cumsum(n))


def _with(docs: DataFrame, model_path: str, text_col: str, keep: list[str] | None, added: list[T.StructField],
          make: Callable[[ChunkTable, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """`keep` columns of `docs` (by default all) and the arrays that `make` gets from the ids of each run of texts."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in added}]
    schema = T.StructType([docs.schema[c] for c in keep] + added)
    source = docs.select(*keep, docs[text_col].cast("string").alias(free_name(docs, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for batch in batches:
            for first, end, ids, at in table.slabs(batch.column(len(keep))):
                columns = [batch.column(k).slice(first, end - first) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns + make(table, ids, at), names=schema.names)
        textkit.release()

    return source.mapInArrow(run, schema)


def _lists(table: ChunkTable, ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]


def _decoded(table: ChunkTable, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[int], str]]:
    """Ids of each text, and the text that the library decodes from them."""
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        some = ids[i:j].tolist()
        yield some, table.model.decode(some) if some else ""


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (columns `keep`, by default all) with `ids`."""
    return _with(docs, model_path, text_col, keep, [IDS], _lists)


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (columns `keep`, by default all) with `ids` and, from them, `decoded`."""

    def make(table: ChunkTable, ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        return [*_lists(table, ids, at), pa.array([t for _, t in _decoded(table, ids, at)], pa.string())]

    return _with(docs, model_path, text_col, keep, [IDS, DECODED], make)


def decode(found: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """`found` with `decoded`; null ids give null."""
    found = without(found, "decoded")
    schema = T.StructType([*found.schema, DECODED])
    at = found.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(model_path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) if ids else "" for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return found.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with n_tokens, and SHA-256 of the comma-joined ids and of the decoded text, without moving ids out of the
    task that makes them."""

    def make(table: ChunkTable, ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        of_ids, of_text, name = [], [], table.strings.__getitem__
        for some, text in _decoded(table, ids, at):
            of_ids.append(hashlib.sha256(",".join(map(name, some)).encode()).hexdigest())
            of_text.append(hashlib.sha256(text.encode()).hexdigest())
        return [pa.array(np.diff(at), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with(docs, model_path, text_col, keep, added, make)


@lru_cache(maxsize=1)
def _table(path: str) -> ChunkTable:
    """The worker's chunk table: tasks that share a worker process share it."""
    return ChunkTable(path)
