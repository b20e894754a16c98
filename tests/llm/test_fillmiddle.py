import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from barline.llm import entry, fillmiddle

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def expected(doc_id, text):
    """The contract, by the letter."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digest(row):
    return (*row[:5], SHA(row[5]))


def test_query_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = entry.op13_fill_in_middle(spark, sf).collect()
    want = sorted(digest(expected(r.doc_id, r.text)) + (SHA(r.text or ""),) for r in rows)
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    pieces = ["a", "Zz", "é", "語", "𝒳", "\n", " ", "<", "<P", "S>", "́", "\0", "9", "<M"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a<S>b"), (1003, "x" * 50_000 + "é" * 50_000), (None, "null id é"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"N": F.lit(1), "FORM": F.lit("x"), "__text": F.lit(2)})
    out = fillmiddle.transform(df)
    assert out.columns == ["doc_id", "text", "__text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fillmiddle.restored()).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert fillmiddle.transform(df.limit(0)).collect() == []


def test_index_converts_both_ways():
    text = "ab語c𝒳é" * 50
    index = fillmiddle.Exceptions.of(np.frombuffer(text.encode(), np.uint8))
    places = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert (index.points(places) == np.arange(len(text) + 1)).all() and (index.places(np.arange(len(text) + 1)) == places).all()
    plain = fillmiddle.Exceptions.of(np.frombuffer(b"only ascii", np.uint8))
    assert (plain.points(np.arange(10)) == np.arange(10)).all() and len(plain.at) == 0
