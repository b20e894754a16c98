"""Fill-in-middle texts: a document is cut into prefix, middle and suffix, and the middle goes last.

Units are runs of ASCII letters and single other code points. A sha256 of the seed and the document's id draws two cuts
between units and the form: `psm` (prefix, suffix, middle), `spm` (suffix, prefix, middle) or `plain` (the text as it
is). Drawing from the id alone, a task that is run again gives the same rows; nothing is shuffled.

Cuts are found in bytes and told in code points through a sparse exception index: for a run of texts only the places of
the multibyte characters and their running excess bytes are kept, and a binary search in them converts either way.
Where a text has none, places are plain differences. Memory is about 20 bytes for each byte of the run in hand.

Defined cases: a null text counts as empty, an empty text is plain with no units; a text that holds one of the marks is
plain, so that a mark in an output is always one that was put there. A null id draws as the empty string. Equal rows
give equal rows. Columns of the input are kept, but for such as are named like an added one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import textkit
from barline.llm.store import free_name

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Per cent of the texts that are transformed, and of these that go suffix first.
RATE, SPM_RATE = 90, 20
ADDED = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]

_BYTES = np.arange(256)
LETTER = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
#: Bytes that a character has beyond its first, by its first byte.
EXCESS = ((_BYTES >= 0xC0).astype(np.int64) + (_BYTES >= 0xE0) + (_BYTES >= 0xF0)) * (_BYTES < 0xF8)


@dataclass(frozen=True)
class Exceptions:
    """The multibyte characters of a run of texts: their byte places, code-point places, and the excess bytes up to and
    with each."""

    at: np.ndarray
    point: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Exceptions:
        at = np.flatnonzero(raw >= 0xC0)
        total = np.cumsum(EXCESS[raw[at]])
        return cls(at, at - np.append(0, total[:-1])[: len(at)], total)

    def points(self, places: np.ndarray) -> np.ndarray:
        """Code points before byte places that begin characters."""
        return places - self._before(np.searchsorted(self.at, places))

    def places(self, points: np.ndarray) -> np.ndarray:
        """Bytes before code points."""
        return points + self._before(np.searchsorted(self.point, points))

    def _before(self, k: np.ndarray) -> np.ndarray:
        return np.where(k > 0, self.total[np.maximum(k - 1, 0)], 0) if len(self.total) else np.zeros(len(k), np.int64)


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where units begin."""
    letter = LETTER[raw]
    starts = (raw & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    return np.flatnonzero(starts)


def draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id."""
    heads = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(heads, ">u4").reshape(-1, 4).astype(np.int64)


def cut(raw: np.ndarray, offsets: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Exceptions]:
    """Units of each text, and the code points (within the run of texts) where its prefix and its middle end."""
    index = Exceptions.of(raw)
    units = index.points(unit_starts(raw, offsets))
    edges = index.points(offsets)
    first = np.searchsorted(units, edges)
    n = np.diff(first)
    units = np.append(units, edges[-1])
    low, high = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1).T
    ends = [np.where(k < n, units[first[:-1] + k], edges[1:]) for k in (low, high)]
    return n, ends[0], ends[1], index


def _run(keep: int, names: list[str], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in textkit.slabs(batch.column(keep)):
                part = batch.slice(first, end - first)
                drawn = draws(part.column(keep + 1).to_pylist(), seed)
                n, low, high, index = cut(raw, offsets, drawn)
                at = index.places(np.concatenate([low, high])).reshape(2, -1)
                edges = index.points(offsets)
                data, forms, outputs = raw.tobytes(), [], []
                for k, (i, j) in enumerate(zip(offsets[:-1], offsets[1:])):
                    text = data[i:j]
                    if not text or drawn[k, 2] % 100 >= RATE or any(m in text for m in MARKS):
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = data[i : at[0, k]], data[at[0, k] : at[1, k]], data[at[1, k] : j]
                    spm = drawn[k, 3] % 100 < SPM_RATE
                    forms.append("spm" if spm else "psm")
                    outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
                plain = np.array([f == "plain" for f in forms])
                sizes = [pa.array(x.astype(np.int64), pa.int64(), mask=plain) for x in (low - edges[:-1], high - low)]
                made = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), *sizes, pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(keep)] + made, names=names)

    return run


def transform(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (columns `keep`, by default all) with n (units), form, prefix_chars and middle_chars (code points; null
    where plain) and output."""
    taken = {f.name for f in ADDED}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    schema = T.StructType([docs.schema[c] for c in keep] + ADDED)
    source = docs.select(
        *keep, docs[text_col].cast("string").alias(free_name(docs, "__text")), docs[id_col].cast("string").alias(free_name(docs, "__id")))
    return source.mapInArrow(_run(len(keep), schema.names, seed), schema)


def restored(form: Column | str = "form", output: Column | str = "output") -> Column:
    """The text, from an output and its form. A transformed output holds each mark once."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    mark = {k: F.lit(m.decode()) for k, m in zip("psm", MARKS)}
    part = lambda text, m, k: F.split_part(text, mark[m], F.lit(k))
    psm = F.concat(part(part(output, "s", 1), "p", 2), part(output, "m", 2), part(part(output, "s", 2), "m", 1))
    spm = F.concat(part(part(output, "p", 2), "m", 1), part(output, "m", 2), part(part(output, "p", 1), "s", 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
