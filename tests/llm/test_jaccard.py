import random

import pytest
from pyspark.sql import functions as F

import twins
from barline.llm import jaccard


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs, passage = {}, " ".join(rng.choices(vocab, k=30))
    for base in range(12):
        words = rng.choices(vocab, k=rng.randint(3, 60))
        for _ in range(rng.randint(1, 9)):
            new = [rng.choice(vocab) if rng.random() < rng.choice((0, 0, 0.02, 0.05)) else w for w in words]
            text = " ".join(new)
            if rng.random() < 0.4:
                text = passage + "\n" + text
            docs[len(docs) * 3 + 1] = text.upper() if rng.random() < 0.1 else text
    docs |= {1001: "", 1002: None, 1003: " \n\t ", 1004: "one", 1005: "ONE", 1006: "one two three", 1007: "É é É é É", 1008: "é é é é é"}
    return docs


@pytest.mark.parametrize("seed,members,visits", [(1, 256, 256), (2, 3, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, members, visits):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "VISITS", visits)
    docs = corpus(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("cls", F.lit("extra")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == twins.near_documents(docs)


def test_hot_copies_repeats_and_null_ids(spark):
    long_ = " ".join(f"x{i % 997}" for i in range(30_000))
    rows = [(i, "a b c d e f g") for i in range(300)] + [(7, "a b c d e f g"), (None, "a b c d e f g"), (900, long_), (901, long_ + " y"), (902, "z")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert all(by[i] == {0} for i in range(300)) and by[None] == {None} and by[900] == by[901] == {900} and by[902] == {902}


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(3, "a b c d e f"), (1, "a b c d e f"), (2, "q"), (4, ""), (5, ""), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(df.withColumn("_gone", F.lit(1))).collect()) == ["1", "2", "4", "5", "None"]


def test_keep_one_decides_by_row(spark):
    a, b = "one two three four five six seven eight nine ten", "red blue green white black grey pink brown teal gold"
    keep = lambda rows: sorted((r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "ROOT": F.lit(2)})).collect())
    # One id on two texts: each is judged in its own component. Equal rows stay once.
    assert keep([(1, a), (2, a), (2, b), (3, b + " x"), (1, a)]) == [(1, a), (2, b)]
    # One id on two texts of one component: one row stays.
    near = b + " x"
    assert keep([(7, b), (7, near), (8, b)]) in ([(7, b)], [(7, near)])
    # The least id is shared by two components.
    assert keep([(1, a), (1, b), (2, a), (2, b)]) == [(1, a), (1, b)]
    assert keep([(1, ""), (1, ""), (2, " "), (3, a)]) == [(1, ""), (1, ""), (2, " "), (3, a)]


def test_prefix_filter_loses_no_link():
    rng = random.Random(5)
    import numpy as np

    order = jaccard.Order(np.random.default_rng(1).integers(0, 50, jaccard.SKETCH))
    for _ in range(300):
        pool = np.array(rng.sample(range(1, 10**9), 60), np.uint64)
        a = np.sort(pool[: rng.randint(3, 50)])
        b = np.sort(np.unique(np.concatenate([rng.sample(list(a), max(1, int(len(a) * 0.9))), pool[50 : 50 + rng.randint(0, 8)]]))).astype(np.uint64)
        if jaccard.linked([a], [b])[0, 0] and len(b) >= 3 and (len(a) != len(b) or (a != b).any()):
            shared = set(order.prefix(a)[0].tolist()) & set(order.prefix(b)[0].tolist())
            assert len(shared) >= jaccard.NEED
