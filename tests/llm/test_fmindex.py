import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import twins
from barline.llm import fmindex
from barline.llm.entry import op6_fm_decontamination


@pytest.mark.parametrize("n,symbols,seed", [(1, 1, 0), (50, 1, 1), (400, 3, 2), (3000, 40, 3)])
def test_index_finds_all_occurrences(n, symbols, seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([[0], rng.integers(1, symbols + 1, n), [0]])
    order = fmindex.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = fmindex.Index(text)
    for size in (1, 2, 5):
        if n < size:
            continue
        phrases = np.array([text[i : i + size] for i in rng.integers(1, n - size + 2, 30)] + [np.full(size, symbols + 5)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def case(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(str(i), " ".join(rng.choices(vocab, k=rng.randint(1, 25)))) for i in range(12)] + [("7", "é ü ñ"), ("x", None), ("y", "!!"), (None, "only here now")]
    docs = {}
    for i in range(60):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 15)))]
        for _ in range(rng.randint(0, 3)):
            words = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(words) - 1))
            parts.append(" ".join(words[a : a + rng.randint(1, 25)]).upper() + rng.choice((",", "\n", " zz ")))
        docs[i] = rng.choice((" ", " -- ")).join(parts)
    docs |= {100: None, 101: "", 102: "...", 103: "w1 " * 30_000 + "Only HERE, now"}
    return docs, items


@pytest.mark.parametrize("block,shard", [(200_000, 1 << 20), (20, 1 << 20)])
def test_contamination_matches_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(fmindex, "PHRASE_WORDS", block)
    docs, items = case(3)
    want = twins.contaminated(docs, [(n or "", t) for n, t in items if t])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("SPANS", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = fmindex.contamination(df, bench).collect()
    for r in found:
        n, hit, names = want[r.doc_id]
        assert (r.n_words, set(r["items"])) == (n, names)
        assert {k for s in r.spans for k in range(s["first"], s["last"] + 1)} == hit
    cut = fmindex.without_spans(fmindex.contamination(df, bench)).collect()
    assert {r.doc_id: r.text for r in cut} == {i: None if t is None else twins.cut_words(t, want[i][1]) for i, t in docs.items()}


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in fmindex.contamination(docs, none).collect()] == [(2, [], [])]
    assert fmindex.contamination(docs.limit(0), none).collect() == []


def test_query_digest(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = twins.contaminated(docs, items)
    for r in op6_fm_decontamination(spark, sf).collect():
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    assert any(hit for _, hit, _ in want.values())


def test_texts_are_cut_without_another_worker(spark):
    rows = [(1, "über alles, wörter 日本 end", [(0, 0, 0, 5), (2, 3, 13, 27)]), (2, "abc", []), (3, None, []), (4, "all", [(0, 0, 0, 3)]),
            (5, "one two three", [(1, 1, 4, 7)])]
    span = "array<struct<first: long, last: long, start: long, end: long>>"
    found = spark.createDataFrame(rows, f"doc_id long, text string, spans {span}").selectExpr("*", "0L AS n_words", "array('x') AS items")
    out = fmindex.without_spans(found)
    assert out.columns == ["doc_id", "text"] and "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "InArrow" not in plan
    want = {i: t if not s else "".join(p.decode() for p in pieces(t.encode(), s)) for i, t, s in rows}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want


def pieces(raw, spans):
    at = 0
    for _, _, start, end in spans:
        yield raw[at:start]
        at = end
    yield raw[at:]
