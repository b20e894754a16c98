"""Near-duplicate vectors by spherical k-means cells.

Vectors link when their labels are equal and their cosine, in double precision, is `COSINE` or more.

1. Equal vectors of a label are one class with a count, so a vector that a third of all rows repeat is one row. They are
   told apart by 128 bits of hash, so only their representative is moved, in the width it came in.
2. Spherical k-means is fitted on a sample of at most `SAMPLE` classes and `SAMPLE_BYTES` (those of least hash), for about `CELL` classes of
   one label a cell and at most `CELLS` cells. Every class is then assigned.
3. A class lives in its nearest cell and visits each cell that is less than `MARGIN` radians further. A pair of nearby
   vectors in two cells is compared where one of them visits the other's cell. With a margin of arccos(COSINE) no pair
   can be missed; the default is smaller, since the angles of two close vectors to a third point rarely differ by much
   of that bound in many dimensions. Recall against brute force is tested.
4. Only classes of one label are compared. Those that live in a cell are dealt into blocks by hash. A task holds one
   block and lets the later blocks and the visitors pass by, in chunks, so a row is sent once for each block, not for
   each pair of small ones. A block has at most `BLOCK` rows and `BLOCK_BYTES`, of a small table a `SPREAD`th. A task
   gives counts and a spanning set of links, never pairs.
5. Connected components of the links give the groups; the one with the least id in each is kept.

Defined cases: null, empty and zero vectors and such with null or non-finite components link with nothing, nor do
vectors with a null label or of different lengths; repeated rows are copies and link; null ids take part in no link and
have no component. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.graph import components
from barline.llm.store import saved
from barline.session import shuffle_partitions

COSINE = 0.93
MARGIN = 0.15
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
CELL = 1 << 15
CELLS = 512
BLOCK = 1 << 15
BLOCK_BYTES = 64 << 20
SPREAD = 32
#: Rows that pass by a block, in blocks.
CHUNK = 4
#: Rows and columns of one product, and the components up to which single pairs of it are gone through.
TILE = 512, 1024
DENSE = 1 << 22
TURNS = 10


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means: centres on the unit sphere; an emptied cell keeps its centre."""
    centres = sample[np.random.default_rng(7).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(TURNS):
        home = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1, 1))


def directions(vec: pa.ListArray, dim: int) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no length overflows or vanishes."""
    x = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return unit(x / np.abs(x).max(axis=1, keepdims=True))


def _place(centres, margin: float):
    """Adds to each row its dimension, its home and all cells that it is in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["vec"].value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                mine = [c for c in centres.value if c.shape[1] == dim]
                far = angles(directions(part["vec"], dim), mine[0]) if mine else np.zeros((len(part), 1))
                row, cell = np.nonzero(far <= far.min(axis=1, keepdims=True) + margin)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(part), dim, np.int32)), pa.array(far.argmin(axis=1).astype(np.int32)),
                     pa.ListArray.from_arrays(ends.astype(np.int32), cell.astype(np.int32))], [*part.schema.names, "dim", "home", "cells"])

    return run


GROUP = ["label", "dim", "cell"]
KEY = [*GROUP, "low", "chunk"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Rows of one key that lie together, those that are held and those that pass apart."""
    for batch in batches:
        if batch.num_rows:
            keys = [batch[k].to_numpy(zero_copy_only=False) for k in [*KEY, "passing"]]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield tuple(k[a] for k in keys[:-1]), bool(keys[-1][a]), batch.slice(a, b - a)


class _Side:
    """Rows that are held, or some that pass."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        self.id, self.n, self.home = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("id", "n", "home"))
        self.x = np.concatenate([directions(p["vec"], dim) for p in parts])
        self.short = self.x.astype(np.float32)
        self.links = np.zeros(len(self.id), np.int64)

    def counts(self) -> pa.RecordBatch:
        k = np.flatnonzero(self.links)
        return _found(self.id[k], self.links[k])


def _found(ids: np.ndarray, links: np.ndarray | None = None, others: np.ndarray | None = None) -> pa.RecordBatch:
    links = np.zeros(len(ids), np.int64) if links is None else links
    other = pa.nulls(len(ids), pa.int64()) if others is None else pa.array(others, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), other], ["id", "links", "other"])


def close_pairs(a: _Side, b: _Side, rows: slice, cols: slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs in one tile with that cosine or more. Single precision rules out what is far by more than its
    error, double precision decides."""
    rough = a.short[rows] @ b.short[cols].T >= cosine - (a.x.shape[1] + 4) * 2.0**-23
    if not rough.any():
        none = np.zeros(0, np.int64)
        return none, none
    i, k = np.nonzero(rough)
    if len(i) * a.x.shape[1] > DENSE:
        i, k = np.nonzero(a.x[rows] @ b.x[cols].T >= cosine)
        return i + rows.start, k + cols.start
    i, k = i + rows.start, k + cols.start
    sure = np.einsum("ij,ij->i", a.x[i], b.x[k]) >= cosine
    return i[sure], k[sure]


class _Held:
    """A block that is held while others pass by."""

    def __init__(self, key: tuple, parts: list[pa.RecordBatch], cosine: float):
        self.cell, self.cosine = key[2], cosine
        self.side = _Side(parts, key[1])
        visits = [p["cells"] for p in parts]
        counts = np.concatenate([v.value_lengths().to_numpy() for v in visits])
        cells = np.concatenate([v.flatten().to_numpy() for v in visits])
        self.visits = np.zeros((len(counts), cells.max() + 1), bool)
        self.visits[np.repeat(np.arange(len(counts)), counts), cells] = True
        self.root = np.arange(len(counts))

    def _met(self, other: _Side, cols: slice) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Linked pairs of held rows and those in `cols` of the other side, a tile at a time, and where the tile begins."""
        for start in range(0, len(self.side.id), TILE[0]):
            i, k = close_pairs(self.side, other, slice(start, min(start + TILE[0], len(self.side.id))), cols, self.cosine)
            use = self.side.id[i] != other.id[k]
            yield i[use], k[use], start

    def _join(self, ids: np.ndarray, root: np.ndarray, i: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Joins the parts that linked pairs lie in, one link for each part that ends; `root` is brought up to date."""
        pairs = np.stack([root[i], root[k]])
        while (pairs := pairs[:, pairs[0] != pairs[1]]).size:
            low, high = pairs.min(axis=0), pairs.max(axis=0)
            into = np.arange(len(root))
            np.minimum.at(into, high, low)
            gone = np.unique(high)
            yield _found(ids[gone], others=ids[into[gone]])
            while (into[into] != into).any():
                into = into[into]
            root[:], pairs = into[root], into[pairs]

    def alone(self) -> Iterator[pa.RecordBatch]:
        """The pairs inside the block: each tile on or above the diagonal once, for both of a pair."""
        side = self.side
        for first in range(0, len(side.id), TILE[1]):
            for i, k, start in self._met(side, slice(first, min(first + TILE[1], len(side.id)))):
                above = i < k
                i, k = i[above], k[above]
                np.add.at(side.links, i, side.n[k])
                np.add.at(side.links, k, side.n[i])
                yield from self._join(side.id, self.root, i, k)
                if start + TILE[0] >= first + TILE[1]:
                    break

    def passed(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        other, mine = _Side([part], self.side.x.shape[1]), len(self.root)
        # A pair whose homes differ counts in the higher-numbered home, and in the lower only if it can't be met above.
        above = (other.home > self.cell) & (other.home < self.visits.shape[1])
        ids, root = np.concatenate([self.side.id, other.id]), np.concatenate([self.root, mine + np.arange(len(other.id))])
        for first in range(0, len(other.id), TILE[1]):
            for i, k, _ in self._met(other, slice(first, min(first + TILE[1], len(other.id)))):
                use = ~above[k]
                use[~use] = ~self.visits[i[~use], other.home[k[~use]]]
                i, k = i[use], k[use]
                np.add.at(self.side.links, i, other.n[k])
                np.add.at(other.links, k, self.side.n[i])
                yield from self._join(ids, root, i, mine + k)
        self.root = root[:mine]
        yield other.counts()


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None

        def hold() -> Iterator[pa.RecordBatch]:
            nonlocal held, parts
            held, parts = _Held(now, parts, cosine), []
            if now[-1] == 0:
                yield from held.alone()

        for key, passing, part in _runs(batches):
            if key != now:
                if parts:
                    yield from hold()
                if held:
                    yield held.side.counts()
                now, held = key, None
            if not passing:
                parts.append(part)
                continue
            if parts:
                yield from hold()
            if held:
                yield from held.passed(part)
        if parts:
            yield from hold()
        if held:
            yield held.side.counts()

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, margin: float = MARGIN) -> DataFrame:
    """One row per row of `vectors`: (vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    narrow = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    given = F.col(vec_col) if narrow else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), given.alias("given"))
    vec = F.col("given").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    # Vectors of one direction are equal: scaled by the largest component, which is found once, zeros without a sign.
    scaled = F.transform(F.array(F.array_max(F.transform(vec, F.abs))), lambda m: F.transform(vec, lambda x: x / m + 0.0))
    hashes = F.transform(scaled, lambda v: F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b")))
    rows = rows.withColumn("same", F.when(finite, F.get(hashes, F.lit(0))))
    keys = ["label", "same"]
    good = rows.where("id is not null and label is not null and same is not null")
    classes = saved(good.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("given").alias("vec")), "vectors")

    one = classes.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    total, squares, longest = one.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")), F.max("dim")).first()
    centres = []
    if total:
        sample = classes.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(1, SAMPLE_BYTES // (8 * longest)))).select("vec").toPandas()["vec"]
        for dim, some in sample.groupby(sample.str.len()):
            # Of labels of different size, the one of a class that is picked at random counts.
            centres.append(fit(directions(pa.array(some), dim), int(min(CELLS, max(1, squares / total // CELL)))))
    shared = spark.sparkContext.broadcast(centres)
    placed = classes.select("id", "label", "n", "vec").mapInArrow(
        _place(shared, margin), f"id long, label string, n long, vec {classes.schema['vec'].dataType.simpleString()}, dim int, home int, cells array<int>")
    placed = placed.withColumn("cell", F.explode("cells")).withColumn("at_home", F.col("cell") == F.col("home"))

    # The rows are placed twice, which costs less than to write them once for each visit.
    sizes = saved(placed.groupBy(*GROUP).agg(F.count_if("at_home").alias("homes"), F.count("*").alias("all")).where("homes > 0"), "cells")
    most = F.greatest(F.lit(1), F.least(F.lit(min(BLOCK, max(256, (total or 0) // SPREAD))), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * 8))))
    sizes = sizes.select(*GROUP, F.ceil(F.col("homes") / most).cast("int").alias("blocks"), F.ceil(F.col("all") / (most * CHUNK)).cast("int").alias("chunks"))
    dealt = placed.join(sizes, GROUP).withColumns({
        "block": F.pmod(F.xxhash64("id"), "blocks").cast("int"), "mine": F.pmod(F.xxhash64(F.lit(1), "id"), "chunks").cast("int")})
    place = lambda low, chunk, passing: F.struct(low.alias("low"), chunk.alias("chunk"), F.lit(passing).alias("passing"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    held = F.when(F.col("at_home"), F.transform(upto(F.col("chunks")), lambda c: place(F.col("block"), c, False)))
    passing = F.transform(upto(F.when(F.col("at_home"), F.col("block")).otherwise(F.col("blocks"))), lambda k: place(k, F.col("mine"), True))
    met = dealt.withColumn("to", F.explode(F.concat(F.coalesce(held, F.filter(passing, lambda _: F.lit(False))), passing))).select(
        *GROUP, "to.*", "id", "n", "home", F.when(~F.col("to.passing"), F.col("cells")).alias("cells"), "vec")
    # Products are heavy for few bytes: a fixed partition count keeps them spread out.
    found = saved(met.repartition(shuffle_partitions(spark), *KEY).sortWithinPartitions(*KEY, "passing").mapInArrow(_compare(cosine), "id long, links long, other long"), "compared")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null"), "id", "other")
    labels = classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        *keys, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component"))
    keyed = rows.select("id", *keys).join(labels, keys, "left")
    own = keyed.withColumn("usable", F.col("id").isNotNull() & F.col("component").isNotNull())
    return own.select(
        F.col("id").alias("vec_id"), F.when(F.col("usable"), F.col("n_links")).otherwise(F.lit(0)).alias("n_links"),
        F.when(F.col("usable"), F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce(F.col("id") == F.when(F.col("usable"), F.col("component")).otherwise(F.col("id")), F.lit(False)).alias("kept"))
