import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import twins
from barline.llm import cells


def brute(rows):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            good[k] = x / np.linalg.norm(x)
    links = [(a, b) for a, b in combinations(good, 2) if rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cells.COSINE]
    degree = np.zeros(len(rows), int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    at = {k: n for n, k in enumerate(order)}
    root = twins.roots(range(len(rows)), [(at[a], at[b]) for a, b in links])
    return sorted((str(i), int(degree[k]), str(rows[order[root[at[k]]]][0])) for k, (i, _, _) in enumerate(rows))


def clusters(seed, n=400, dim=16, spread=0.08):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 8, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dim)) * spread * rng.choice([0.3, 1.0], size=(n, 1))
    return [(int(i) * 3, [float(y) for y in v * rng.uniform(0.1, 9)], int(rng.integers(0, 3))) for i, v in enumerate(x)]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash")).repartition(3)
    got = cells.near_duplicates(df, **more).collect()
    assert all(r.kept == (r.vec_id == r.component_id and r.vec_id is not None) for r in got)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got)


def test_exact_with_the_full_margin(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 20)
    monkeypatch.setattr(cells, "BLOCK", 8)
    rows = clusters(1)
    assert run(spark, rows, margin=math.acos(cells.COSINE)) == brute(rows)


def test_recall_with_the_default_margin(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 20)
    rows = clusters(2, 600, 64, 0.03)
    got, want = run(spark, rows), brute(rows)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) > 0


def test_defined_cases(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [1.0, float("inf")], [1e300, 1e300], [1e-300, 1e-300], [1.0, 1.0], [1.0, 1.0, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(20, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [1.0, 1.0, 0.0], 1)] + [(i, [0.5, -0.5], 7) for i in range(100, 400)]
    assert run(spark, rows) == brute(rows)
    assert cells.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_a_dense_group_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 700)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    rows = [(i, [float(y) for y in centre + rng.normal(size=24) * s], 4) for i, s in enumerate(rng.choice([0.05, 0.4, 2.0], 1500))]
    assert run(spark, rows) == brute(rows)


def test_a_row_is_moved_a_few_times(spark, monkeypatch):
    # A label is four blocks here and a chunk: a row is held by one task and passes by those of the blocks before its own.
    moved, compare = spark.sparkContext.accumulator(0), cells._compare

    def counted(*given):
        inner = compare(*given)

        def run(batches):
            def each():
                for batch in batches:
                    moved.add(len(batch))
                    yield batch
            yield from inner(each())
        return run

    monkeypatch.setattr(cells, "_compare", counted)
    vectors = np.random.default_rng(6).normal(size=(20_000, 32))
    df = spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    assert cells.near_duplicates(df).count() == len(vectors)
    assert 0 < moved.value <= 4 * len(vectors)
