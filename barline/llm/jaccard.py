"""N-gram Jaccard join over a token-group matrix.

Texts become sets of distinct 5-word shingles (64-bit hashes). Equal sets are one class. The join then goes:

1. **Counts.** A fixed-size counter array over all sets orders the shingles, rare ones first (`Order`).
2. **Shared prefixes.** A set with `n` shingles and overlap need `t = ceil(3n/4)` gives its first `n - t + 3` in that
   order. Two linked sets share three or more of these, so a class with fewer shared ones is done.
3. **Groups.** A class joins the group of the shingle that most other classes give, cut by set size and, past
   `MEMBERS`, by hash. Similar documents meet in one group, since they share their commonest prefix shingle.
4. **Matrix.** Each group stores the union of its members' prefixes as rows (token, group). A query class may hold a
   link into a group only where its overlap with that union is three or more and the sizes fit; only such groups open.
5. **Opening.** Members and visiting queries of one group meet in one task, at most `MEMBERS` by `VISITS`, and whole
   sets are compared as blocks of 0/1 matrices. A block yields a spanning set of links, never all pairs.

Copies never meet each other past step 1, so a text with a third of all rows is one row. A shingle in very many sets is
last in the order; where it is still in prefixes its rows are dealt out by class, not by shingle.

Defined cases: null, empty or blank texts have `n_shingles` 0 and are their own component; fewer than five words are
one shingle; null ids get a null component; repeated rows are copies; rows of one id with different texts are separate
texts. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import textkit
from barline.llm.graph import components
from barline.llm.store import counter, counter_rows, saved
from barline.session import shuffle_partitions

WIDTH = 5
SKETCH = 1 << 20
NEED = 3
MEMBERS = 256
VISITS = 256
BITS = 1 << 23
BUCKETS = 1024
FLUSH = 500_000
SEEN = 500_000
SLAB = 2048
#: Bytes of text in hand at once.
RUN = 1 << 20
#: Bytes of a shingle's hash that travel for the comparison of two sets.
KEPT = 6
_MANY = 1 << 40


def text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order. Slabs are small, since a worker holds some ten times their bytes."""
    for first, end, raw, offsets in textkit.slabs(texts, RUN):
        starts, ends, owner = textkit.spans(raw, offsets, textkit.SPACED)
        yield from textkit.shingles(textkit.hashes(raw, starts, ends), owner, end - first, WIDTH)


def signature(found: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    total = textkit.mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(found))
    return int(textkit.mix(np.array([total], np.uint64)).view(np.int64)[0])


def need(n: np.ndarray | int):
    return (3 * n + 3) // 4


def _count_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        sizes, names, waiting, held = [], [], [], 0
        for found in text_sets(batch.column(1)):
            sizes.append(len(found))
            names.append(signature(found) if len(found) else None)
            waiting.append(found)
            held += len(found)
            if held > FLUSH:
                counts += np.bincount((np.concatenate(waiting) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                waiting, held = [], 0
        if held:
            counts += np.bincount((np.concatenate(waiting) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        rows = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * rows, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
             batch.column(2), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
            names=["kind", "id", "n", "cls", "mark", "piece", "data"])
    pieces = list(counter_rows(counts))
    rows = len(pieces)
    yield pa.RecordBatch.from_arrays(
        [pa.array([1] * rows, pa.int32()), *[pa.nulls(rows, pa.int64())] * 4,
         pa.array([p for p, _ in pieces], pa.int32()), pa.array([d for _, d in pieces], pa.binary())],
        names=["kind", "id", "n", "cls", "mark", "piece", "data"])


class Order:
    """Shingles by how often their counter was hit, on a fine logarithmic scale, then by hash. `hot`: on this scale, a
    shingle that must be in many sets."""

    def __init__(self, counts: np.ndarray):
        self.level = np.round(np.log2(counts + 1.0) * 1000).astype(np.uint16)
        self.hot = int(np.log2(16 * counts.mean() + 4000) * 1000)

    def prefix(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a sorted set in this order, and which of them are hot."""
        level = self.level[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
        n = len(found)
        first = np.argsort(level, kind="stable")[: n - need(n) + NEED]
        return found[first], level[first] >= self.hot


def _prefix_rows(order, buckets: int):
    """Rows (bucket, tokens, classes): the prefix entries of a run of documents, packed by bucket. Within a bucket 40
    more bits of a shingle tell it from others; a rare chance match costs a candidate, no link. Hot shingles keep all
    bits and are dealt to further buckets by run, not by shingle."""

    def rows(waiting: list) -> pa.RecordBatch:
        tokens = np.concatenate([w[0] for w in waiting])
        hot = np.concatenate([w[1] for w in waiting])
        cls = np.repeat(np.array([w[2] for w in waiting], np.int64), [len(w[0]) for w in waiting])
        bucket = (tokens % np.uint64(buckets)).astype(np.int32)
        bucket[hot] = buckets + (waiting[0][2] & 0x7FFFFFFF) % buckets
        by = np.argsort(bucket, kind="stable")
        tokens, cls, bucket = tokens[by], cls[by], bucket[by]
        bits = (tokens // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :5]
        cuts = textkit.runs(bucket)
        ranges = list(zip(cuts[:-1], cuts[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts[:-1]], pa.int32()),
             pa.array([(bits if bucket[i] < buckets else tokens)[i:j].tobytes() for i, j in ranges], pa.binary()),
             pa.array([cls[i:j].tobytes() for i, j in ranges], pa.binary())], names=["bucket", "tokens", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, seen, waiting, held = order.value, set(), [], 0
        for batch in batches:
            for found in text_sets(batch.column(1)):
                if len(found) < NEED or (name := signature(found)) in seen:
                    continue
                if len(seen) >= SEEN:  # copies that are far apart in the file are collapsed in the bucket
                    seen.clear()
                seen.add(name)
                tokens, hot = by.prefix(found)
                waiting.append((tokens, hot, name))
                held += len(tokens)
                if held >= FLUSH:
                    yield rows(waiting)
                    waiting, held = [], 0
        if waiting:
            yield rows(waiting)

    return run


def _shared(buckets: int):
    """Of each bucket, the (token, sets, class) entries whose token two classes or more give; sets: how many do."""

    def settle(parts: list, bucket: int) -> pd.DataFrame:
        cls = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
        if bucket >= buckets:
            tokens = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
            return pd.DataFrame({"token": tokens, "sets": _MANY, "cls": cls})
        whole = np.zeros((len(cls), 8), np.uint8)
        whole[:, :5] = np.concatenate([np.frombuffer(p[0], np.uint8) for p in parts]).reshape(-1, 5)
        tokens = whole.view(np.int64).ravel()
        by = np.lexsort((cls, tokens))
        tokens, cls = tokens[by], cls[by]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])
        tokens, cls = tokens[keep], cls[keep]
        many = np.diff(textkit.runs(tokens))
        sets = np.repeat(many, many)
        tokens = (tokens << 23) | bucket
        return pd.DataFrame({"token": tokens[sets > 1], "sets": sets[sets > 1], "cls": cls[sets > 1]})

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


def unpacked_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return np.sort(out.view(np.uint64).ravel())


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets, by 0/1 matrices over slabs of their common tokens."""
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    if not len(common):
        return out
    place = [np.searchsorted(common, x) for x in (a, b)]
    hit = [common[np.minimum(p, len(common) - 1)] == x for p, x in zip(place, (a, b))]
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    place, owner = [p[h] for p, h in zip(place, hit)], [o[h] for o, h in zip(owner, hit)]
    for at in range(0, len(common), SLAB):
        sides = []
        for p, o, s in zip(place, owner, (left, right)):
            inside = (p >= at) & (p < at + SLAB)
            matrix = np.zeros((len(s), min(SLAB, len(common) - at)), np.float32)
            matrix[o[inside], p[inside] - at] = 1
            sides.append(matrix)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """100 * intersection >= 75 * union, for each pair."""
    met = overlaps(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 7 * met >= 3 * sizes


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (block, salt, role, cls, data), sorted: members of a block first, then its visitors."""
    key, names, sets, label, ready = None, [], [], None, False
    visit_names: list[int] = []
    visit_sets: list[np.ndarray] = []
    edges: list[tuple[int, int]] = []

    def settle_members() -> None:
        nonlocal label
        links = linked(sets, sets)
        label = np.arange(len(sets))
        while True:
            least = np.minimum(label, np.where(links, label[None, :], len(sets)).min(axis=1))
            if (least == label).all():
                break
            label = least
        if key[1] == 0:
            edges.extend((names[i], names[k]) for i, k in enumerate(label) if i != k)

    def settle_visits() -> None:
        if visit_sets and sets:
            for name, row in zip(visit_names, linked(visit_sets, sets)):
                edges.extend((name, names[k]) for k in np.unique(label[row]))
        visit_names.clear()
        visit_sets.clear()

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges]}, dtype="int64")
        edges.clear()
        return out

    for batch in batches:
        for block, salt, role, cls, data in batch.itertuples(index=False):
            if (block, salt) != key or role and not ready:
                if key is not None and not ready and sets:
                    settle_members()
                    ready = True
                if (block, salt) != key:
                    settle_visits()
                    key, names, sets, ready = (block, salt), [], [], False
            found = unpacked_set(data)
            if role:
                visit_names.append(cls)
                visit_sets.append(found)
                if len(visit_sets) >= MEMBERS:
                    settle_visits()
            elif not names or names[-1] != cls:
                names.append(cls)
                sets.append(found)
        if edges:
            yield flush()
    if key is not None and not ready and sets:
        settle_members()
    settle_visits()
    yield flush()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, data = [], []
        for found in text_sets(batch.column(1)):
            names.append(signature(found) if len(found) else None)
            data.append(found.view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["cls", "data"])


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `docs` (id, text) whose id may be in `wanted`: a bitmap of BITS bits, in 32-kbit pieces, filters in the
    scan. It lets a few others through."""
    place = F.pmod(F.xxhash64("id"), F.lit(BITS))
    pieces = wanted.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("piece")).agg(
        F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    met = docs.withColumn("p", place).withColumn("piece", F.expr("p div 32768")).join(F.broadcast(pieces), "piece")
    byte = F.conv(F.hex(F.expr("substring(bits, cast((p % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(p % 8 as int))")) != 0).select("id", "text")


def _links(texts: DataFrame, named: DataFrame, order: Order) -> DataFrame:
    """Links (a, b) between classes that connect all that is connected. `named`: (id, n, cls) of all documents."""
    spark = texts.sparkSession
    buckets = max(BUCKETS, 4 * shuffle_partitions(spark))
    prefixes = texts.mapInArrow(textkit.tidied(_prefix_rows(spark.sparkContext.broadcast(order), buckets)), "bucket int, tokens binary, cls binary")
    entries = prefixes.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(textkit.tidied(_shared(buckets)), "token long, sets long, cls long")
    # A class has as many entries as its prefix, so they may stand in one row.
    given = entries.groupBy("cls").agg(F.collect_set(F.struct("sets", "token")).alias("given")).where(F.size("given") >= NEED)
    given = saved(given, "given")

    band = F.floor(F.log("n") / F.lit(float(np.log(4 / 3)))).alias("band")
    classes = given.select("cls", F.array_max("given").getField("token").alias("grp")).join(
        named.groupBy("cls").agg(F.first("n").alias("n")), "cls").select("cls", "n", "grp", band)
    parts = classes.groupBy("grp", "band").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    members = classes.join(parts, ["grp", "band"]).select(
        "cls", "n", F.xxhash64("grp", "band", F.pmod(F.xxhash64("cls"), "parts")).alias("block"))
    sizes = members.groupBy("block").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    members = saved(members.join(sizes, "block"), "members")

    # Of two blocks the smaller visits the larger.
    own = given.join(members, "cls").select("cls", "n", "block", "size", "low", "high", F.explode("given.token").alias("token"))
    matrix = own.groupBy("token", "block").agg(F.first("size").alias("g_size"), F.first("low").alias("low"), F.first("high").alias("high"))
    asked = own.select("token", "cls", "n", F.col("block").alias("home"), "size")
    visits = (
        asked.join(matrix, "token")
        .where("size < g_size or size = g_size and home < block")
        .where("4 * n >= 3 * low and 4 * high >= 3 * n")
        .groupBy("cls", "block").agg(F.count("*").alias("met")).where(F.col("met") >= NEED).select("cls", "block")
    )
    visits = saved(visits, "visits")

    load = visits.groupBy("block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("salts"))
    seats = members.join(load, "block", "left").where("size > 1 or salts is not null").select(
        "cls", "block", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.lit(0).alias("role"))
    guests = visits.join(load, "block").select(
        "cls", "block", F.pmod(F.xxhash64("cls"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
    places = saved(seats.unionByName(guests), "places")

    wanted = named.join(places.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))
    sets = _only(texts, wanted).mapInArrow(textkit.tidied(_set_rows), "cls long, data binary")
    # Either side grows with the documents, so neither is ever broadcast.
    met = places.hint("merge").join(sets, "cls").select("block", "salt", "role", "cls", "data")
    return met.repartition("block", "salt").sortWithinPartitions("block", "salt", "role", "cls").mapInPandas(
        textkit.tidied(_open), "a long, b long")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of `docs`: (id, n, mark: a hash of the text, root: a class of its component, component: the least
    id in it, n_copies)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = texts.withColumn("mark", F.xxhash64("text"))
    first = saved(marked.mapInArrow(textkit.tidied(_count_sets), "kind int, id long, n long, cls long, mark long, piece int, data binary"), "sets", "kind")
    rows = first.where("kind = 0").select("id", "n", "cls", "mark")
    order = Order(counter(first.where("kind = 1").select("piece", "data"), SKETCH))

    named = rows.where("id is not null and cls is not null")
    edges = _links(texts.where("id is not null"), named.drop("mark"), order)
    roots = components(edges, "a", "b")
    classes = named.groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("n_copies"))
    rooted = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ends = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.join(ends, "root").select("cls", "root", "component", "n_copies")
    return rows.join(labels, "cls", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, n_shingles, component_id, n_copies), ids as long.

    `component_id` is the least id that links of similarity 0.75 or more reach; `n_copies` is the number of rows with
    the same shingle set.
    """
    return _labelled(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay when of each component one row does: that of the least id, of several texts under
    this id the one with the least hash, of several equal rows any one.

    Rows without an id, and rows without a word, all stay."""
    found = _labelled(docs, id_col, text_col).where("id is not null and n > 0")
    # Rows are told apart by id and text: one id may stand on texts of different components.
    stays = found.groupBy("root", "id", "mark").agg(F.count("*").alias("times")).groupBy("root").agg(
        F.min(F.struct("id", "mark", "times")).alias("best")).select(
            F.col("best.id").alias("_id"), F.col("best.mark").alias("_mark"), F.col("best.times").alias("_times"))
    own, mark = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    free = own.isNull() | ~F.coalesce(docs[text_col].cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    columns = [docs[c] for c in docs.columns]
    met = docs.where(~free).join(stays, (own == stays["_id"]) & (mark == stays["_mark"]))
    once = met.where(stays["_times"] == 1).select(*columns)
    again = met.where(stays["_times"] > 1).dropDuplicates(["_id", "_mark"]).select(*columns)
    return docs.where(free).unionByName(once).unionByName(again)
