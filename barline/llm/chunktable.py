"""Token ids of many texts at once, by a table of the distinct chunks that were met.

A chunk is a stretch of a text whose ids do not depend on what is around it. A slab of whole texts is cut into chunks,
its distinct chunks are looked up by hash, those not yet known go to the tokenizer once, and all ids are put back by
position. What a chunk is, and its tokenizer, are the subclasses'.

The table is a task worker's own. Behind `limit` chunks it starts anew, which repeats work at a rate that does not grow
with the data and drops nothing. Chunks are told apart by two 64-bit hashes; one that shares the first with another is
given to the tokenizer by itself wherever it stands.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from barline.llm import textkit


class ChunkTable:
    limit = 1_500_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin, in the bytes of texts that begin at `offsets`: the starts of all that are not empty, and
        places between."""
        raise NotImplementedError

    def segment(self, chunks: list[bytes]) -> list:
        """Ids of each chunk."""
        raise NotImplementedError

    def _flat(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.segment([data[i:j] for i, j in zip(starts.tolist(), ends.tolist())])
        size = np.fromiter(map(len, found), np.int64, len(found))
        if found and isinstance(found[0], np.ndarray):
            return np.concatenate(found), size
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def _learn(self, data: bytes, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, size = self._flat(data, starts, ends)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.first, self.size = np.insert(self.first, at, first), np.insert(self.size, at, size)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the `end` ids behind it, and the number of each text's ids."""
        starts = self.cuts(raw, offsets) if len(raw) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        keys, checks = (textkit.hashes(raw, starts, ends, values) for values in textkit.CASED)
        order = np.argsort(keys)
        heads = textkit.runs(keys[order])
        where, place = order[heads[:-1]], np.empty(len(keys), np.int64)
        place[order] = np.repeat(np.arange(len(where)), np.diff(heads))
        distinct = keys[where]
        if len(self.keys) + len(distinct) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != distinct
        if new.any():
            some = where[new]
            self._learn(raw.tobytes(), distinct[new], checks[some], starts[some], ends[some])
            at = np.searchsorted(self.keys, distinct)
        rows = at[place]
        size, first, ids = self.size[rows], self.first[rows], self.ids
        clash = np.flatnonzero(self.checks[rows] != checks)
        if len(clash):
            own, sizes = self._flat(raw.tobytes(), starts[clash], ends[clash])
            size[clash], first[clash] = sizes, len(ids) + np.cumsum(sizes) - sizes
            ids = np.concatenate([ids, own])
        owner = np.searchsorted(offsets, starts, "right") - 1
        n = np.bincount(owner, size, len(offsets) - 1).astype(np.int64) + len(end)
        out = np.empty(int(n.sum()), np.int32)
        before = np.cumsum(size) - size
        inside = np.arange(int(size.sum()))
        out[inside + np.repeat(owner * len(end), size)] = ids[inside + np.repeat(first - before, size)]
        last = np.cumsum(n)
        for k, x in enumerate(end):
            out[last - len(end) + k] = x
        return out, n
