"""Line de-duplication over a deletion neighbourhood of units.

A line is what stands between line feeds, compared by its words (runs without ASCII white space, ASCII in lower case).
All lines with a word are compared for equality. Two lines are near when one unit inserted, deleted or replaced turns
one into the other. A unit is a word; in scripts that are written without blanks each character is one. That is asked
of lines of `NEAR` or more, where a word counts `WORD` and such a character one, so that an edit is at most a quarter of
a line. Of equal lines the earliest stays, in order of id, text hash and place in the text. A line also goes when any
earlier line is near it, whether or not that one stays itself.

The neighbourhood of a line is its own key, its keys with one unit deleted, and these keys with the place of the
deletion; equal keys of the last kind mean one replaced unit, a line's own key equal to another's deletion means one
inserted unit. Only the earliest line of a key matters: where a task meets a placed key again, the later line is decided
there and only the earliest goes on, so a template with one changing word sends one entry a task however many lines fit
it. Keys travel packed by bucket. The partner so found is verified unit by unit. Copies of a line are one row before its
neighbourhood is made.

Most lines have no neighbour and need no variants: near lines share their first or last half. Halves that two different
lines share are set in a bitmap of fixed size; lines without such a half are left out, which loses nothing.

Defined cases: null texts stay null, texts without line feeds are one line, blank lines stay, null ids come last in
order. Rows that repeat one id and text are one document and all get its result. Columns of the input are kept, but for
such as are named like an added one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import textkit
from barline.llm.store import free_name, saved, without
from barline.session import shuffle_partitions

WORD, NEAR = 2, 8
#: Units of the shortest line that has near ones.
LEAST = NEAR // WORD
#: Characters of scripts without blanks: Thai, Lao, Tibetan, Burmese, Khmer, kana, ideographs.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
BITS = 1 << 25
SEEN = 300_000
BUCKETS = 256
FLUSH = 500_000
ROWS = 512
SLAB = 1 << 20
_FEED = 10
_LAST = (1 << 63) - 1


def unspaced(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each character of a script without blanks."""
    at = np.flatnonzero(raw >= 0xE0)
    four = raw[at] >= 0xF0
    tail = [raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) & 63 for k in (1, 2, 3)]
    point = (raw[at].astype(np.int64) & 15) << 12 | tail[0] << 6 | tail[1]
    point = np.where(four, (raw[at].astype(np.int64) & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], point)
    met = np.zeros(len(at), bool)
    for low, high in UNSPACED:
        met |= (point >= low) & (point <= high)
    return at[met], (at + 3 + four)[met]


class Lines:
    """Word hashes of a slab and the lines that they make, for equality; the units of the lines, for nearness; hashes of
    any run of either in one step."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        starts, ends, owner = textkit.spans(raw, offsets, textkit.SPACED)
        self.words = textkit.hashes(raw, starts, ends)
        feeds = np.flatnonzero(raw == _FEED)
        number = np.searchsorted(feeds, starts)  # feeds before the word, in the slab
        before = np.searchsorted(feeds, offsets[:-1])
        cuts = textkit.runs(number + owner)  # either grows at a new line, neither falls
        self.first, self.end = cuts[:-1], cuts[1:]
        if not len(starts):
            self.first = self.end = np.zeros(0, np.int64)
        self.n = self.end - self.first
        self.text = owner[self.first]
        self.line = number[self.first] - before[self.text]
        self.units, self.u_first, self.u_end, self.weight = self.words, self.first, self.end, self.n * WORD
        single, after = unspaced(raw)
        if len(single) and len(starts):
            cuts = np.unique(np.concatenate([starts, single, after]))
            word = np.searchsorted(starts, cuts, "right") - 1
            inside = cuts < ends[word]
            cuts, word = cuts[inside], word[inside]
            self.units = textkit.hashes(raw, cuts, np.minimum(np.append(cuts[1:], len(raw)), ends[word]))
            self.u_first, self.u_end = np.searchsorted(word, self.first), np.searchsorted(word, self.end)
            each = np.concatenate([[0], np.cumsum(np.where(np.isin(cuts, single), 1, WORD))])
            self.weight = each[self.u_end] - each[self.u_first]
        self.near = self.weight >= NEAR
        self.total = [self._sums(self.words), self._sums(textkit.mix(self.words ^ np.uint64(77)))]
        self.total.append(self.total[0] if self.units is self.words else self._sums(self.units))
        self.down = textkit.powers(len(self.units) + 2)[1]

    @staticmethod
    def _sums(hashes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * textkit.powers(len(hashes) + 2)[0][: len(hashes)])])

    def run(self, first: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return (self.total[which][end] - self.total[which][first]) * self.down[first]

    def keys(self, which: int = 0) -> np.ndarray:
        return textkit.mix(self.run(self.first, self.end, which) + self.n.astype(np.uint64))

    def halves(self) -> np.ndarray:
        """Four keys a line: its first and last units, as many as half a line of its length or one less has."""
        out, size = [], self.u_end - self.u_first
        for half in (size // 2, (size - 1) // 2):
            salt = half.astype(np.uint64) * np.uint64(4)
            out.append(textkit.mix(self.run(self.u_first, self.u_first + half, 2) + salt))
            out.append(textkit.mix(self.run(self.u_end - half, self.u_end, 2) + salt + np.uint64(1)))
        return np.stack(out, axis=1)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, hash, text) to one row for each line with a word."""
    for batch in batches:
        for first, end, raw, offsets in textkit.slabs(batch.column(2), SLAB):
            lines = Lines(raw, offsets)
            if not len(lines.n):
                continue
            ids = batch.column(0).slice(first, end - first).take(pa.array(lines.text))
            marks = batch.column(1).slice(first, end - first).take(pa.array(lines.text))
            halves = lines.halves().view(np.int64)
            units = lines.u_end - lines.u_first
            size = np.where(lines.near, np.where((units % 2 == 1) | (units == LEAST), 2, 4), 0)  # nothing shorter than LEAST is near
            use = np.arange(4)[None, :] < size[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(halves[use]))
            yield pa.RecordBatch.from_arrays(
                [ids, marks, pa.array(lines.line.astype(np.int32)), pa.array(lines.keys().view(np.int64)),
                 pa.array(lines.keys(1).view(np.int64)), lists], names=["id", "mark", "line", "k1", "k2", "halves"])


def _candidates(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text) to (k1, k2, unit hashes) of each different line that may have a neighbour."""
        flags, seen = np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            for _, _, raw, offsets in textkit.slabs(batch.column(0), SLAB):
                lines = Lines(raw, offsets)
                halves = lines.halves() % np.uint64(BITS)
                met = (flags[halves >> np.uint64(3)] >> (halves & np.uint64(7)).astype(np.uint8)) & 1 == 1
                k1, k2 = lines.keys().view(np.int64), lines.keys(1).view(np.int64)
                rows = []
                for k in np.flatnonzero(met.any(axis=1) & lines.near):
                    name = int(k1[k])
                    if name in seen:
                        continue
                    if len(seen) >= SEEN:  # copies further apart meet in the aggregation
                        seen.clear()
                    seen.add(name)
                    rows.append((name, int(k2[k]), lines.units[lines.u_first[k] : lines.u_end[k]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["k1", "k2", "words"])

    return run


OWN, DELETED, PLACED = 0, 1, 2


def neighbourhood(words: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A line's own key, and its keys with each unit deleted: without and with the place."""
    n = len(words)
    up, down = textkit.powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])])
    own = textkit.mix(total[-1:] + np.uint64(n))
    deleted = textkit.mix(total[:-1] + (total[-1] - total[1:]) * down[1] + np.uint64(n - 1))
    placed = textkit.mix(deleted + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(own[0]), deleted, placed


def _variants(buckets: int, flush: int):
    """Rows (place number, unit hashes), in any order, to packed entries by bucket of their key; pairs that are decided here
    go to buckets beyond the last."""

    def pack(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(bucket, kind="stable")
        cuts = textkit.runs(bucket[by])
        ranges = list(zip(cuts[:-1], cuts[1:]))
        packed = [pa.array([c[by[i:j]].tobytes() for i, j in ranges], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(bucket[by[cuts[:-1]]], pa.int32()), *packed], names=["bucket", "keys", "places", "kinds"])

    def rows(run_: list) -> Iterator[pa.RecordBatch]:
        size = [len(r[2]) for r in run_]
        place = np.repeat(np.array([r[0] for r in run_], np.int64), size)
        deleted, placed = (np.concatenate([r[k] for r in run_]) for k in (2, 3))
        by = np.lexsort((place, placed))  # earliest first among equals, in whatever order the rows were read
        heads = textkit.runs(placed[by])
        first = by[heads[:-1]]
        later = np.ones(len(by), bool)
        later[heads[:-1]] = False
        if later.any():
            least = np.repeat(place[first], np.diff(heads))[later]
            pairs = np.unique(np.stack([place[by[later]], least]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            if pairs.shape[1]:
                yield pack((buckets + pairs[0] % buckets).astype(np.int32), pairs[0], pairs[1], np.zeros(pairs.shape[1], np.uint8))
        keys = np.concatenate([placed[first], deleted[first], np.array([r[1] for r in run_], np.uint64)])
        places = np.concatenate([place[first], place[first], np.array([r[0] for r in run_], np.int64)])
        kinds = np.repeat(np.array([PLACED, DELETED, OWN], np.uint8), [len(first), len(first), len(run_)])
        yield pack((keys % np.uint64(buckets)).astype(np.int32), keys, places, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(data, np.uint64)
                waiting.append((place, *neighbourhood(words)))
                held += len(words)
                if held >= flush:
                    yield from rows(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from rows(waiting)

    return run


def _meet(buckets: int):
    """Packed entries of a bucket to pairs (place number, place number of an earlier neighbour)."""

    def settle(parts: list, bucket: int) -> pd.DataFrame:
        keys, places, kinds = (np.concatenate([np.frombuffer(p[k], t) for p in parts]) for k, t in ((0, np.uint64), (1, np.int64), (2, np.uint8)))
        if bucket >= buckets:
            return pd.DataFrame({"place": keys.view(np.int64), "partner": places})
        out = []
        for wants, gives in ((PLACED, PLACED), (DELETED, OWN), (OWN, DELETED)):
            mine, theirs = np.flatnonzero(kinds == wants), np.flatnonzero(kinds == gives)
            by = theirs[np.lexsort((places[theirs], keys[theirs]))]
            by = by[textkit.runs(keys[by])[:-1]]  # the earliest of each key
            if not len(by) or not len(mine):
                continue
            at = np.minimum(np.searchsorted(keys[by], keys[mine]), len(by) - 1)
            later = (keys[by][at] == keys[mine]) & (places[by][at] < places[mine])
            out.append(np.stack([places[mine][later], places[by][at][later]]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"place": pairs[0], "partner": pairs[1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for batch in batches:
            for bucket, *part in batch.itertuples(index=False):
                if parts and bucket != now:
                    yield settle(parts, now)
                    parts = []
                now = bucket
                parts.append(part)
        if parts:
            yield settle(parts, now)

    return run


def one_apart(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at most one unit inserted, deleted or replaced turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    return head + tail >= max(len(a), len(b)) - 1


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        near = [one_apart(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch["words"], batch["p_words"])]
        yield batch.loc[near, ["k1", "k2"]]


def _bitmap(keys: DataFrame, name: str) -> bytes:
    """A bitmap of BITS bits of keys modulo BITS (as unsigned numbers); its size is fixed, so it may go everywhere."""
    place = F.col(name).bitwiseAND(F.lit(BITS - 1))
    rows = keys.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("piece")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    out = bytearray(BITS // 8)
    for piece, bits in rows.toLocalIterator():
        out[piece * 4096 : piece * 4096 + 4096] = bits
    return bytes(out)


def _place(id_: str = "id") -> Column:
    return F.struct(F.coalesce(id_, F.lit(_LAST)).alias("doc"), F.col("mark"), F.col("line"))


def _near(texts: DataFrame, rows: DataFrame, different: DataFrame) -> DataFrame:
    """(k1, k2) of different lines that an earlier one is near to."""
    shared = rows.select("k1", F.explode("halves").alias("half")).groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b")
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(shared, "half"))
    found = texts.select("text").mapInArrow(textkit.tidied(_candidates(bits)), "k1 long, k2 long, words binary")
    found = saved(found.dropDuplicates(["k1", "k2"]), "candidates")
    # Numbered in order of place: numbers of one table, so that they stay.
    sorted_ = found.join(different, ["k1", "k2"]).repartitionByRange("first").sortWithinPartitions("first")
    lines = saved(sorted_.select(F.monotonically_increasing_id().alias("place"), "k1", "k2", "words"), "ordered")

    buckets = max(BUCKETS, 4 * shuffle_partitions(texts.sparkSession))
    entries = lines.select("place", "words").mapInArrow(textkit.tidied(_variants(buckets, FLUSH)), "bucket int, keys binary, places binary, kinds binary")
    pairs = entries.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(textkit.tidied(_meet(buckets)), "place long, partner long").distinct()
    partners = lines.select(F.col("place").alias("partner"), F.col("words").alias("p_words"))
    met = pairs.join(lines, "place").join(partners, "partner").select("k1", "k2", "words", "p_words")
    return met.mapInPandas(textkit.tidied(_verify), "k1 long, k2 long").distinct()


def _cut(schema: T.StructType, at: int):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts, n_lines, n_kept = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = [] if text is None else text.split("\n")
                n_lines.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [x for k, x in enumerate(lines) if k not in gone]
                    text = "\n".join(lines)
                n_kept.append(len(lines))
                texts.append(text)
            columns = [pa.array(texts, batch.column(k).type) if k == at else batch.column(k) for k in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_kept, pa.int64())], names=names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its texts cut to the lines that stay, n_lines (before) and n_kept."""
    docs = without(docs, "n_lines", "n_kept")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    rows = saved(texts.mapInArrow(textkit.tidied(_line_rows), "id long, mark long, line int, k1 long, k2 long, halves array<long>"), "lines")
    different = saved(rows.groupBy("k1", "k2").agg(F.min(_place()).alias("first")), "different")
    near = _near(texts, rows, different).withColumn("near", F.lit(True))
    fates = different.join(near, ["k1", "k2"], "left")
    gone = rows.select("k1", "k2", _place().alias("place")).join(fates, ["k1", "k2"]).where("near or place <> first")
    gone = gone.groupBy(F.col("place.doc").alias("_doc"), F.col("place.mark").alias("_mark")).agg(F.collect_set("place.line").alias("_gone"))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)) == gone["_doc"]) & (F.xxhash64(docs[text_col]) == gone["_mark"])
    met = docs.join(gone, same, "left").select(*(docs[c] for c in docs.columns), gone["_gone"].alias(free_name(docs, "gone")))
    schema = T.StructType([*docs.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_kept", T.LongType())])
    return met.mapInArrow(textkit.tidied(_cut(schema, docs.columns.index(text_col))), schema)


def with_content(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of `dedup_lines` that lost nothing or still have a line with a word."""
    return found.where((F.col("n_kept") == F.col("n_lines")) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
