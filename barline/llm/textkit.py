"""Words and hashes of many texts at once, as numpy arrays over the bytes of an Arrow string column.

Texts are UTF-8, so a rule that names ASCII characters can be read off the bytes: each byte of another character is
0x80 or above. Memory stays near ten bytes per byte of the slab in hand; a slab is a run of whole texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB = 4 << 20
STEP = 1 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words: all but ASCII white space, or ASCII digits and letters with everything beyond ASCII.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (_BYTES >= 0x80)

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
#: Two more tables of byte values, which tell upper from lower case.
CASED = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C13  # odd, so it has an inverse modulo 2**64
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, STEP + 4096)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    x ^= x >> np.uint64(32)
    return x


def release() -> None:
    """Give freed memory back to the system: a worker that goes on to other stages would keep what it once held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run):
    """`run`, a function of the batches of a task, with freed memory given back when the task ends."""
    def whole(batches):
        yield from run(batches)
        release()
    return whole


def slabs(texts: pa.Array, size: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `size` bytes: first text, end, bytes, offsets of the texts in them. Nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def spans(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of its text."""
    inside = word[raw]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span; by default with upper-case ASCII taken as lower case."""
    out = np.zeros(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(raw) + 1, STEP)), len(starts)))
    for i, j in zip(cuts[:-1], cuts[1:]):
        low, high = starts[i], ends[j - 1]
        up, down = powers(int(high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[raw[low:high]] * up[: high - low], out=total[1:])
        out[i:j] = mix((total[ends[i:j] - low] - total[starts[i:j] - low]) * down[starts[i:j] - low])
    return out


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)


def shingles(words: np.ndarray, texts: np.ndarray, n_texts: int, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes. Fewer words than `width` make one shingle, none make none."""
    out = [np.zeros(0, np.uint64)] * n_texts
    if not len(words):
        return out
    whole = len(words) - width + 1
    rolled = np.zeros(max(whole, 0), np.uint64)
    for k in range(width if whole > 0 else 0):
        rolled = rolled * np.uint64(_BASE) + words[k : whole + k]
    rolled = mix(rolled)
    cuts = runs(texts)
    for i, j in zip(cuts[:-1], cuts[1:]):
        if j - i >= width:
            found = np.sort(rolled[i : j - width + 1])
            keep = np.ones(len(found), bool)
            keep[1:] = found[1:] != found[:-1]
            out[texts[i]] = found[keep]
        else:
            value = np.full(1, j - i, np.uint64)
            for w in words[i:j]:
                value = value * np.uint64(_BASE) + w
            out[texts[i]] = mix(value)
    return out
