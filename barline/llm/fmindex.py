"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task, up to `SHARD` words. Words are `[0-9a-z]` and all beyond ASCII, lower-cased
in ASCII. Words that no test phrase has can't be part of a hit; they only separate, and stretches between them that are
shorter than the shortest phrase are left out, which loses nothing. What remains is indexed whole: suffix array by
prefix doubling, its last column in a wavelet tree (one bit row per level, popcount ranks), and every `SAMPLE`-th
position kept. Test phrases (windows of ten words, shorter items whole) are searched backward, all at once; occurrences
are located by walking to the next sampled position; hit words of a document merge into spans.

The index lives as long as its task, so a lost executor only repeats its shards. Nothing is shuffled. Phrases come in
blocks of `PHRASE_WORDS`, each broadcast and searched in its own pass over rows that carry what earlier passes found;
so the size of a broadcast is bounded whatever the benchmark has.

Defined cases: null or wordless texts have no words and no hits; items without words or with null text have no phrases;
a null item id counts as the empty string; equal ids are one item. Repeated rows each get their own result. Columns of
the input are kept, but for such as are named like an added one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import textkit
from barline.llm.store import without

WINDOW = 10
SHARD = 1 << 19
#: Bytes of text in hand at once.
RUN = 1 << 20
SAMPLE = 8
PHRASE_WORDS = 200_000


def word_codes(texts: pa.Array) -> Iterator[tuple]:
    """Per slab: first text, end, word hashes, owners, start and end bytes inside the text."""
    for first, end, raw, offsets in textkit.slabs(texts, RUN):
        starts, ends, owner = textkit.spans(raw, offsets, textkit.ALNUM)
        yield first, end, textkit.hashes(raw, starts, ends), owner, starts - offsets[owner], ends - offsets[owner]


class Phrases:
    """Distinct windows of a block of items, as rows of word codes (0: no phrase has the word), by length."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.words = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        windows: dict[tuple, set[str]] = defaultdict(set)
        for name, words in items:
            code = self.encode(words)
            size = min(WINDOW, len(code))
            for i in range(len(code) - size + 1):
                windows[tuple(code[i : i + size].tolist())].add(name)
        self.by_size: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in sorted({len(k) for k in windows}):
            keys = sorted(k for k in windows if len(k) == size)
            self.by_size[size] = (np.array(keys, np.int64), [sorted(windows[k]) for k in keys])
        self.shortest = min(self.by_size, default=1)

    def encode(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + 1, 0)


class Bits:
    """A bit row with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.blocks), np.int64)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.blocks[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks of any symbol in a sequence, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max()).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in reversed(range(self.depth)):
            bit = (symbols >> level) & 1 == 1
            self.levels.append((Bits(bit), int((~bit).sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros(len(at), np.int64)
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            a, b = bits.rank(low), bits.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, low = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for bits, zeros in self.levels:
            one = bits.get(place)
            a, b = bits.rank(low), bits.rank(place)
            low, place = np.where(one, zeros + a, low - a), np.where(one, zeros + b, place - b)
            symbol = symbol * 2 + one
        return symbol, place - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    width = max(1, int(symbols.max()).bit_length() + 1)
    step = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols + 1, np.zeros(step, np.int64)])
    for k in range(step):
        key = (key << width) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n, np.int64)
    while not head.all():
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = first + 1
        tied = ~head
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        some = order[places]
        ahead = some + step
        key = (rank[some] << 32) | np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        by = np.argsort(key, kind="stable")
        order[places], key = some[by], key[by]
        head[places[1:]] = key[1:] != key[:-1]
        step *= 2
    return order


class Index:
    """FM-index of a sequence of word codes; code 0 separates and ends it."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.n = len(symbols)
        self.tree = Wavelet(last)
        counts = np.bincount(symbols)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        marked = order % SAMPLE == 0
        self.marks = Bits(marked)
        self.samples = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes start with each phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        alive = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, k]
            known = symbol < len(self.below) - 1
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            if not len(alive):
                break
            ends = np.concatenate([low[alive], high[alive]])
            found = self.below[np.tile(symbol, 2)] + self.tree.rank(np.tile(symbol, 2), ends)
            low[alive], high[alive] = found[: len(alive)], found[len(alive) :]
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled one, then add the steps."""
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            done = self.marks.get(rows)
            out[open_[done]] = self.samples[self.marks.rank(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, rank = self.tree.at(rows)
            rows = self.below[symbol] + rank
            steps += 1
        return out


def _stretches(code: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols to index, and for each the number of its word (-1: a separator). Begins and ends with a separator."""
    known = code > 0
    edge = np.ones(len(code) + 1, bool)
    edge[1:-1] = (owner[1:] != owner[:-1]) | ~known[1:] | ~known[:-1]
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        return np.zeros(1, np.int64), np.full(1, -1)
    starts, sizes = cuts[:-1], np.diff(cuts)
    keep = known[starts] & (sizes >= shortest)
    starts, sizes = starts[keep], sizes[keep]
    total = int(sizes.sum()) + len(sizes) + 1
    symbols, words = np.zeros(total, np.int64), np.full(total, -1)
    at = np.repeat(np.cumsum(sizes) - sizes + np.arange(1, len(sizes) + 1), sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    source = np.repeat(starts, sizes) + within
    symbols[at + within], words[at + within] = code[source], source
    return symbols, words


def find(code: np.ndarray, owner: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Index one shard, search all phrases: which words are hit, and the items that each text holds."""
    hit, items = np.zeros(len(code) + 1, np.int64), defaultdict(set)
    symbols, words = _stretches(code, owner, phrases.shortest)
    if len(symbols) > 1:
        index = Index(symbols)
        for size, (rows, names) in phrases.by_size.items():
            low, high = index.search(rows)
            met = np.flatnonzero(high > low)
            if not len(met):
                continue
            many = (high - low)[met]
            which = np.repeat(met, many)
            place = np.repeat(low[met] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            for at in range(0, len(place), SHARD):  # a phrase may stand very often in a shard
                word = words[index.locate(place[at : at + SHARD])]
                np.add.at(hit, word, 1)
                np.add.at(hit, word + size, -1)
                pairs = np.unique(np.stack([owner[word], which[at : at + SHARD]]), axis=1)
                for text, k in pairs.T:
                    items[int(text)].update(names[k])
    return np.cumsum(hit[:-1]) > 0, items


def _pass(block, text_at: int, keep: list[int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        for batch in batches:
            rows = batch.num_rows
            n_words = np.zeros(rows, np.int64)
            spans = [list(map(dict, s)) for s in batch.column(batch.num_columns - 2).to_pylist()]
            items = [set(i) for i in batch.column(batch.num_columns - 1).to_pylist()]
            shard, held = [], 0

            def settle(shard=shard, spans=spans, items=items) -> None:
                code, owner, starts, ends = (np.concatenate(x) for x in zip(*shard))
                hit, found = find(code, owner, phrases)
                for text, names in found.items():
                    items[text] |= names
                places = np.flatnonzero(hit)
                if len(places):
                    cut = np.flatnonzero((places[1:] != places[:-1] + 1) | (owner[places[1:]] != owner[places[:-1]])) + 1
                    first = np.concatenate([[0], cut])
                    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    for i, j in zip(first, np.append(cut, len(places))):
                        a, b = places[i], places[j - 1]
                        spans[owner[a]].append({"first": int(number[a]), "last": int(number[b]), "start": int(starts[a]), "end": int(ends[b])})
                shard.clear()

            for first, end, words, owner, starts, ends in word_codes(batch.column(text_at)):
                n_words[first:end] = np.bincount(owner, minlength=end - first)
                shard.append((phrases.encode(words), owner + first, starts, ends))
                held += len(words)
                if held >= SHARD:
                    settle()
                    held = 0
            if held:
                settle()
            columns = [batch.column(k) for k in keep]
            columns += [pa.array(n_words), pa.array(list(map(_merged, spans)), schema.field("spans").type), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: s["first"]):
        if out and span["first"] <= out[-1]["last"] + 1:
            if span["last"] > out[-1]["last"]:
                out[-1] |= {"last": span["last"], "end": span["end"]}
        else:
            out.append(dict(span))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("first", "last", "start", "end")]))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items with their word hashes, in blocks of PHRASE_WORDS words; a longer item is a block of its own."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    for name, text in rows.where(F.col(text_col).isNotNull()).toLocalIterator():
        for _, _, words, *_ in word_codes(pa.array([text])):
            if len(words):
                block.append((name, words))
                held += len(words)
        if held >= PHRASE_WORDS:
            yield block
            block, held = [], 0
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with n_words (long), spans (hit stretches: first and last word, start and end byte) and items (distinct item ids, sorted)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    context, docs = docs.sparkSession.sparkContext, without(docs, "n_words", "spans", "items")
    now = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast(SPAN).alias("spans"), F.array().cast("array<string>").alias("items"))
    text_at = docs.columns.index(text_col)
    blocks = list(map(context.broadcast, map(Phrases, item_blocks(benchmark, item_col, item_text_col))))
    for k, block in enumerate(blocks):
        keep = [i for i in range(len(docs.columns)) if keep_text or k < len(blocks) - 1 or i != text_at]
        schema = T.StructType([now.schema[i] for i in keep] + list(now.schema)[-3:])
        now = now.mapInArrow(textkit.tidied(_pass(block, text_at, keep, to_arrow_schema(schema))), schema)
    return now


def without_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts without their hit stretches; n_words, spans and items go. Cut by built-in expressions: a second Python
    worker a task would cost as much memory as the first."""
    raw, spans = F.encode(F.col(text_col).cast("string"), "UTF-8"), F.array_sort("spans")
    # What lies before the first stretch, between two, and behind the last. Stretches do not meet.
    opens = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    closes = lambda i: F.coalesce(F.get(spans, i)["start"], F.octet_length(text_col))
    between = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.decode(
        F.substring(raw, (opens(i) + 1).cast("int"), (closes(i) - opens(i)).cast("int")), "UTF-8"))
    cut = F.when(F.size("spans") > 0, F.array_join(between, "")).otherwise(F.col(text_col))
    columns = [c for c in found.columns if c not in ("n_words", "spans", "items")]
    return found.select(*(cut.alias(c) if c == text_col else F.col(c) for c in columns))
