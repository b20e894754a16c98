from collections import Counter
from zlib import crc32

import twins
from barline.llm import language
from barline.llm.entry import op9_rank_order_language


def grams(text):
    """N-grams of letter classes, as codes."""
    kinds, out = language.classes(), Counter()
    word = [0]
    for c in [*map(ord, text), 0]:
        k = int(kinds[c])
        if k:
            word.append(k)
            continue
        word.append(0)
        for i in range(1, len(word) - 1):
            a, b, c_ = word[i - 1 : i + 2]
            out.update([b, language.ONE + a * 64 + b, language.TWO + (a * 64 + b) * 64 + c_])
            if c_ == 0:
                out.update([language.ONE + b * 64])
        word = [0]
    return out


def nearest(text, known):
    mine = twins.profile(grams(text or ""))
    if not mine or not known:
        return "und", 0.0
    best = min((sum(abs(r - p.index(g)) if g in p else 300 for r, g in enumerate(mine)) / len(mine), lang) for lang, p in sorted(known.items()))
    return best[1], 1 - best[0] / 300


def test_matches_brute_force(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("Das Straßenfest, übermorgen!", "de"),
            ("THE END of the day", "en"), ("un été à la mer", "fr"), (None, "en"), ("123 !!", "fr"), ("", "de"), ("日本語 テスト", "ja"), ("no label here", None)] * 3)]
    rows += [(None, "le le le", "en"), (4, "x" * 50_000, None)]
    counts = {}
    for i, t, lang in rows:
        if i is not None and t and lang and crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(grams(t))
    known = {lang: twins.profile(c) for lang, c in counts.items() if c}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'clash' as SCORE").repartition(3)
    got = language.predict(df).collect()
    key = lambda i, t: (str(i), str(t))
    want = {key(i, t): nearest(t, known) for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        lang, score = want[key(r.doc_id, r.text)]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.predict(df).collect()] == [("und", 0.0)]
    assert language.predict(df.limit(0)).collect() == []


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_rank_order_language(spark, sf).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert language.accepted(language.predict(spark.read.parquet(f"{sf}/documents.parquet"))).count() == len(truth)
