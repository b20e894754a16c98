"""Line de-duplication over lines of any length and script."""

import random

import pytest

import twins
from barline.llm import lines

def result(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}


def test_short_lines_and_lines_without_blanks(spark):
    licence, other = "本作品は著作権法により保護されています", "本作品は著作権法により保証されています"
    docs = {1: f"All rights reserved.\n{licence}\nMenu\n\nfour words are here", 2: f"all RIGHTS reserved.\n{licence}\nmenu\n\nfour words stand here",
            3: f"{other}\n全く別の一行です\nyes no", 4: "four words are here now\nno yes\nใช้ภาษาไทยได้เลย", 5: "ใช้ภาษาไทยได้เลยๆ\nyes\nอื่น"}
    got = result(spark, docs)
    assert got == {1: docs[1], 2: "", 3: "全く別の一行です\nyes no", 4: "no yes\nใช้ภาษาไทยได้เลย", 5: "yes\nอื่น"}
    assert got == twins.kept_lines(docs)


@pytest.mark.parametrize("flush", [500_000, 20])
def test_matches_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(lines, "FLUSH", flush)
    rng = random.Random(flush)
    vocab = ["a", "b", "Ç", "“d”", "語", "本語", "x日本", "ไทย", "\U00020000e", "𝒳"]
    base = [rng.choices(vocab, k=rng.randint(1, 9)) for _ in range(30)]
    docs = {}
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(rng.choice(("", " ")) + " ".join(w))
        docs[i] = "\n".join(out)
    assert result(spark, docs) == twins.kept_lines(docs)
