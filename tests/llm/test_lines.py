import random

import pytest
from pyspark.sql import functions as F

import twins
from barline.llm import lines


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(12)]
    base = [rng.choices(vocab, k=rng.randint(1, 14)) for _ in range(40)]
    docs = {}
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(w) + 1)
                rng.choice((lambda: w.insert(at, rng.choice(vocab)), lambda: w.pop(at) if at < len(w) and len(w) > 1 else None,
                            lambda: w.__setitem__(at, rng.choice(vocab)) if at < len(w) else None))()
            out.append(rng.choice(("  ", "", "\t")) + " ".join(w).title())
        docs[i] = "\n".join(out)
    docs |= {100: None, 101: "", 102: "\n\n", 103: "a b c d\na b c d\r\nA  B\tC D", 104: "x"}
    return docs


@pytest.mark.parametrize("flush", [500_000, 20])
def test_matches_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(lines, "FLUSH", flush)
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({"_gone": F.lit(1), "N_LINES": F.lit(2)}).repartition(3)
        got = lines.dedup_lines(df).collect()
        want = twins.kept_lines(docs)
        assert {r.doc_id: r.text for r in got} == want
        assert all(r.n_lines == (0 if docs[r.doc_id] is None else docs[r.doc_id].count("\n") + 1) for r in got)


def test_halves_and_variants_lose_no_neighbour():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(8, 20))]
        b = list(a)
        at = rng.randrange(len(b))
        rng.choice((lambda: b.insert(at, "z"), lambda: b.__setitem__(at, "z")))()
        raw = np.frombuffer((" ".join(a) + "\n" + " ".join(b)).encode(), np.uint8)
        two = lines.Lines(raw, np.array([0, len(raw)]))
        halves = two.halves()
        assert set(halves[0].tolist()) & set(halves[1].tolist())
        w = [two.words[two.first[k] : two.end[k]] for k in (0, 1)]
        (own, _, placed), (_, deleted, other) = (lines.neighbourhood(x) for x in w)
        if len(a) == len(b):
            assert placed[at] == other[at]
        else:
            assert own in deleted
        assert lines.one_apart(*w) and not lines.one_apart(w[0], np.concatenate([w[1], w[1][:2]]))


def test_order_repeats_null_ids_and_long_lines(spark):
    line, wide = "one two three four five six seven eight", " ".join(f"u{i}" for i in range(40_000))
    rows = [(5, line), (2, line.replace("three", "drei")), (2, line.replace("three", "drei")), (None, line), (9, wide + "\nend"), (8, wide + " more")]
    got = sorted((str(r.doc_id), r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", ""), ("2", rows[1][1]), ("2", rows[1][1]), ("None", ""), ("9", "end"), ("8", wide + " more")])
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
