import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barline.functions import text
from barline.operators import feeds, similarity, tagging
from barline.plans import news
from barline.sources import driver_tables as t


def one(spark, column, *values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


# ---- text rules ------------------------------------------------------------

def test_title_key_keeps_wide_letters(spark):
    assert one(spark, text.title_key, "TSMC 台積電：漲 5%!", "A_b " * 40) == ["tsmc台積電漲5", ("a_b" * 40)[:60]]


def test_clean_summary(spark):
    got = one(spark, text.clean_summary, "<p>Hi&nbsp;&#160; there</p>\n<b>x</b>", None, "y" * 300)
    assert got == ["Hi there x", "", "y" * 180]


def test_source_suffix(spark):
    df = spark.createDataFrame([("Up - Wire", "Wire"), ("Up", "Wire"), ("Up - Wire", None)], "a string, b string")
    assert [r[0] for r in df.select(text.cut_source_suffix(F.col("a"), F.col("b"))).collect()] == ["Up", "Up", "Up - Wire"]


def test_news_tokens(spark):
    got = one(spark, text.news_tokens, "Nvidia spends $500 B on AMD；台積電的新廠 12 億", "", "芯")
    assert set(got[0]) == {"nvidia", "amd", "$500B", "12億", "台積", "積電", "新廠", "廠億"}
    assert got[1:] == [[], []]


def test_word_fixes_in_order(spark):
    assert one(spark, text.fix_words, "芯片产能，美联储汇率", None) == ["晶片產能，聯準會匯率", None]


MOVES = ["台積電股價大漲 5%", "NVDA 收高 3.2%", "CPI 年增漲 3%", "營收大漲 20%", "ETH 跌破 $3000", "xNVDAx 漲 5%", "油價漲；5%", "股價持平", "標普收低 約 1.5 %"]


def test_market_sentences_match_python_regex(spark):
    want = [bool(re.search(text.MARKET_MOVE, m)) for m in MOVES]
    assert one(spark, text.reports_move, *MOVES) == want and True in want and False in want
    rng = random.Random(5)
    bodies = ["".join(rng.choice(MOVES) + rng.choice("。；;") for _ in range(rng.randint(1, 5))) + rng.choice(["", " tail "]) for _ in range(60)]

    def strip(body):
        parts = re.split(r"(?<=[。；;])", body)
        kept = [p for p in parts if not re.search(text.MARKET_MOVE, p)]
        return body if len(kept) == len(parts) else "".join(kept).strip()

    assert one(spark, text.strip_market_sentences, *bodies) == [strip(b) for b in bodies]


def test_market_headline_exception(spark):
    assert one(spark, text.is_market_headline, "費半大跌 4%", "營收大漲 20%，股價漲 5%", "平淡") == [True, False, False]


def test_stale_dates(spark):
    df = spark.createDataFrame([("2024-05-01",), ("2024-06-01",), ("2024-5-1",), (None,), ("",)], "x string")
    got = [r[0] for r in df.select(text.is_stale(F.col("x"), F.lit("2024-05-15"))).collect()]
    assert got == [True, False, False, False, False]


def test_content_gate(spark):
    pad = "x" * 800
    cases = [pad + " eps revenue earnings reported", pad + " eps", "eps revenue earnings reported", pad + "No major earnings. no significant earnings eps", None,
             pad + "no major earnings no major earnings " + "eps " * 10]
    assert one(spark, text.has_earnings_content, *cases) == [True, False, False, False, False, True]


def test_reply_helpers(spark):
    assert one(spark, text.first_number, "MOVE at 98.5 today", "in 2024 only 1") == ["98.5", None]
    assert one(spark, text.numbered_topics, "1. Rates. 2. Oil\n3. Chips 4. More", "none") == [["Rates", "Oil", "Chips"], []]
    got = one(spark, text.split_sources, "Answer.\nSources: https://a.b/c and https://d.e", "No tail")
    assert (got[0]["answer"], got[0]["sources"]) == ("Answer.", ["https://a.b/c", "https://d.e"]) and got[1]["sources"] == []


# ---- feeds -----------------------------------------------------------------

def test_ingest_order_of_rules(spark):
    dim = spark.createDataFrame([("f1", 0, 2, 24, False), ("f2", 1, 3, 168, True)], "feed string, feed_pos int, max_items int, max_age_h int, longform boolean")
    now = datetime(2024, 6, 3, 12)
    rows = [
        ("f1", 0, "Old", datetime(2024, 6, 2, 11, 59)), ("f1", 1, "Edge", datetime(2024, 6, 2, 12)), ("f1", 2, "Podcast x", now), ("f1", 3, "  ", now),
        ("f1", 4, "Undated", None), ("f1", 5, "Third", now), ("f2", 0, "edge!", now), ("f2", 1, "Long", now), ("f2", 2, "Same - W", now), ("f2", 3, "Late", now),
    ]
    items = spark.createDataFrame([(f, p, x, "s", "l", "W" if "W" in x else None, d) for f, p, x, d in rows],
                                  "feed string, pos int, title string, summary string, link string, inner_source string, published timestamp_ntz")
    got = news.ingest(items, dim, now).collect()
    # the cap counts before the cross-feed rule: "edge!" uses one of f2's three places
    assert [r["title"] for r in got] == ["Edge", "Undated", "Long", "Same"]
    assert [r["weekly"] for r in got] == [False, False, True, True] and got[3]["source"] == "W"
    assert {r["feed"]: r["kept"] for r in feeds.feed_counts(news.kept_entries(items, dim, now)).collect()} == {"f1": 2, "f2": 2}


def test_caps_come_from_the_feed_table(spark):
    now = datetime(2024, 6, 3, 12)
    dim = spark.createDataFrame([(f"f{i:02d}", i, 25 if i else 40, 24, False) for i in range(14)], "feed string, feed_pos int, max_items int, max_age_h int, longform boolean")
    rows = [(f"f{f:02d}", p, f"title {f}x{p}", "s", "l", None, now) for f in range(14) for p in range(60)]
    items = spark.createDataFrame(rows, "feed string, pos int, title string, summary string, link string, inner_source string, published timestamp_ntz")
    counts = {r["feed"]: r["kept"] for r in feeds.feed_counts(news.kept_entries(items, dim, now)).collect()}
    assert counts == {f"f{i:02d}": 25 if i else 40 for i in range(14)}  # 365 in all, before the overall cap
    got = news.ingest(items, dim, now).collect()
    assert len(got) == 280 and {r["feed"] for r in got} == {f"f{i:02d}" for i in range(11)} and max(r["pos"] for r in got if r["feed"] == "f10") == 14


# ---- tagging ---------------------------------------------------------------

WATCH = [
    ("NVDA", "NVIDIA Corp", ["Nvidia", "輝達"]), ("APP", "AppLovin", []), ("2330.TW", "Taiwan Semiconductor Co.", ["TSMC", "台積電"]), ("V", "Visa Inc.", ["Visa"]),
    ("LOW", "LOW", []), ("ASML", "ASML", []), ("BRK-B", "Berkshire Hathaway", ["Berkshire Hathaway"]), ("T", "AT&T Inc", ["AT&T"]), ("abc", "x", []), ("MMM", "3M Co", ["3M"]),
    ("ABNB", ".NET Holdings", []),
]


def brute_tags(body):
    hits = []
    for ticker, name, aliases in WATCH:
        keys = set(aliases)
        if len(name) >= 4 and name.upper() != ticker.upper():
            keys.add(re.sub(text.LEGAL_SUFFIX, "", name))
        base, word = ticker.split(".")[0], r"(?<![A-Za-z0-9]){}(?![A-Za-z0-9])"
        found = any(re.search(word.format(re.escape(k)), body, re.I) for k in keys if len(k) >= 3)
        found |= base.isalpha() and len(base) >= 3 and bool(re.search(word.format(base), body))
        found |= base.isdigit() and bool(re.search(rf"(?<!\d){base}(?!\d)", body))
        if found:
            hits.append(ticker)
    return hits[:4] or None


def test_tagging_matches_brute_force(spark):
    rng = random.Random(4)
    bits = ["Nvidia", "nvidia's", "xNVDAx", "NVDA", "App", "APP", "2330", "A2330B", "12330", "台積電", "我們台積電公司", "台積", "visa", "Visas", "low", "LOW", "AT&T", "at&t's",
            "Berkshire  Hathaway", "berkshire hathaway", "Berkshire-Hathaway", "ABC", "abc", "3M", "3m", "x.net", ".NET", "Taiwan Semiconductor", "輝達", "AppLovin", "the", "ASML."]
    items = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 4))), " ".join(rng.choice(bits) for _ in range(rng.randint(0, 3)))) for i in range(300)]
    df = spark.createDataFrame(items, "pos int, title string, summary string")
    watch = spark.createDataFrame([(k, n, a, i) for i, (k, n, a) in enumerate(WATCH)], "ticker string, name string, aliases array<string>, pos int")
    got = {r["pos"]: r["watch"] for r in tagging.tag_items(df, watch, ["pos"]).collect()}
    for pos, title, summary in items:
        assert got[pos] == brute_tags(f"{title} {summary}"), (title, summary)


def test_names_that_cannot_change_the_tags_are_not_tried(spark, monkeypatch):
    """A pattern that does not compile stands for a text that is not read again."""
    rules = [("A", 0, "alpha", None), ("A", 0, "alpha of", "("), ("B", 1, "beta", None), ("C", 2, "gamma", None), ("D", 3, "delta", None),
             ("E", 4, "omega", "("), ("F", 5, "zeta of", "(?i)zeta of(?![a-z])"), ("G", 6, "=ZETA", None)]
    frame = spark.createDataFrame(rules, "ticker string, pos int, anchor string, pattern string")
    monkeypatch.setattr(tagging, "watch_patterns", lambda watchlist: frame)
    items = [(1, "Alpha of beta, gamma, delta", "omega"), (2, "alpha of", None), (3, "ZETA of", "delta"), (4, "zeta. Of", None), (5, None, ""), (6, "Zeta of x alpha of", "")]
    got = tagging.tag_items(spark.createDataFrame(items, "pos int, title string, summary string"), frame, ["pos"]).collect()
    assert {r["pos"]: r["watch"] for r in got} == {1: ["A", "B", "C", "D"], 2: ["A"], 3: ["D", "F", "G"], 4: None, 5: None, 6: ["A", "F"]}


def test_tagging_whole_documents(spark, sf):
    """The registered whole-text query against a word-set check."""
    watch = [r.asDict() for r in t.watchlist(spark, sf).collect()]
    got = {r["pos"]: r["watch"] for r in tagging.tag_items(t.news_items(spark, sf), t.watchlist(spark, sf), ["feed", "pos"]).collect()}
    for item in t.news_items(spark, sf).collect():
        body = f"{item['title']} {item['summary']}"
        words = re.findall("[A-Za-z0-9]+", body)
        low = {w.lower() for w in words}
        hits = []
        for w in sorted(watch, key=lambda w: w["pos"]):
            name = re.sub(text.LEGAL_SUFFIX, "", w["name"])
            alias = any(re.search(rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])", body, re.I) for a in w["aliases"])
            if name.lower() in low or w["pos"] in words or alias:
                hits.append(w["ticker"])
        assert got[item["pos"]] == (hits[:4] or None)


def test_watch_order(spark):
    rows = [("a", "A", 3), ("b", "A", 2), ("c", "S", None), ("d", "", 9)]
    got = {r["ticker"]: (r["grade_order"], r["priority"]) for r in tagging.watch_order(spark.createDataFrame(rows, "ticker string, grade string, pass_count int")).collect()}
    assert got == {"a": (1, True), "b": (1, False), "c": (0, True), "d": (9, False)}


# ---- similarity ------------------------------------------------------------

def is_dup(a, b):
    if not a or not b:
        return False
    both = a & b
    if len(both) / len(a | b) >= 0.4:
        return True
    return any(x[0] == "$" or re.search("[億兆萬]", x) for x in both) and any(re.match("[a-z]", x) for x in both)


def greedy(items):
    kept = []
    for key, toks in sorted(items):
        if not any(is_dup(set(toks), k) for _, k in kept):
            kept.append((key, set(toks)))
    return {key for key, _ in kept}


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_matches_greedy(spark, seed):
    rng = random.Random(seed)
    words = ["the", "fed", "tsmc", "oil", "chip", "ai", "rate", "bank", "$5B", "12億", "台積", "積電"] + [f"w{i}" for i in range(25)]
    rows = []
    for day in (1, 2):
        for i in range(90):
            # a third are copies of one item, another part shares one frequent token
            toks = ["the", "fed", "oil"] if i % 3 == 0 else (["the"] if i % 3 == 1 else []) + rng.sample(words, rng.randint(0, 9 if i % 20 else 30))
            rows.append((day, i, sorted(set(toks))))
    df = spark.createDataFrame(rows, "as_of int, pos int, tokens array<string>")
    got = {(r["as_of"], r["pos"]) for r in similarity.keep_first(df, ["as_of"], ["pos"]).collect()}
    want = {(day, p) for day in (1, 2) for p in greedy([(i, toks) for d, i, toks in rows if d == day])}
    assert got == want
    again = similarity.keep_first(df.join(spark.createDataFrame(sorted(got), "as_of int, pos int"), ["as_of", "pos"]), ["as_of"], ["pos"])
    assert again.count() == len(got)  # idempotent


def test_dedup_edges(spark):
    rows = [
        (1, ["a", "b", "c", "d"]), (2, ["c", "d", "e", "f", "g"]), (3, ["e", "f", "g", "h"]),  # chain: 1~? 2, 2~3, 1 and 3 differ
        (10, ["p", "q"]), (11, ["p", "r", "s"]), (12, ["p", "q", "r", "s", "t"]),  # 10~11 1/4, 10~12 exactly 2/5, 11~12 3/5
        (20, ["$5B", "nvidia", "u1", "u2", "u3", "u4"]), (21, ["$5B", "nvidia", "v1", "v2", "v3", "v4", "v5"]), (22, ["$5B", "z1", "z2"]),
        (30, []), (31, []),
    ]
    df = spark.createDataFrame([(0, *r) for r in rows], "as_of int, pos int, tokens array<string>")
    got = {r["pos"] for r in similarity.keep_first(df, ["as_of"], ["pos"]).collect()}
    assert got == greedy([r for r in rows]) and 12 not in got and 21 not in got and {22, 30, 31} <= got


def test_dedup_chain_of_shared_keys_takes_few_rounds(spark, monkeypatch):
    # each set shares a rare word with the one before it, which makes them meet, but none are alike
    rng = random.Random(4)
    rows = [(0, i, [f"k{i}", f"k{i + 1}", *rng.sample([f"w{j}" for j in range(30)], 3)]) for i in range(300)]
    rounds = []
    whole = similarity.behind_duplicates
    monkeypatch.setattr(similarity, "behind_duplicates", lambda live, tokens: rounds.append(1) or whole(live, tokens))
    df = spark.createDataFrame(rows, "as_of int, pos int, tokens array<string>")
    got = {r["pos"] for r in similarity.keep_first(df, ["as_of"], ["pos"]).collect()}
    assert got == greedy([r[1:] for r in rows]) and len(got) > 250
    assert len(rounds) <= 4


def test_dedup_keys_with_more_sets_than_heads(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HEADS", 2)
    rng = random.Random(5)
    rows = [(0, i, sorted({"x", *rng.sample([f"w{j}" for j in range(9)], rng.randint(1, 5))})) for i in range(120)]
    df = spark.createDataFrame(rows, "as_of int, pos int, tokens array<string>")
    assert {r["pos"] for r in similarity.keep_first(df, ["as_of"], ["pos"]).collect()} == greedy([r[1:] for r in rows])


def test_pairs_are_ruled_out_before_they_are_moved(spark):
    """Sets that share one frequent word are no candidates; true duplicates always are, by words or by a couple."""
    rng = random.Random(7)
    words = ["$5B", "nvidia", *[f"w{j}" for j in range(40)]]
    sets = [sorted(set(rng.sample(words, rng.randint(1, 12)))) for _ in range(60)] + [["$5B", "nvidia", *[f"{c}{j}" for j in range(9)]] for c in "pq"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(sets)], "i int, t array<string>")
    side = lambda c: df.select(F.col("i").alias(f"i{c}"), F.col("t").alias(c), similarity.token_bits(F.col("t")).alias(f"b{c}"))
    pairs = side("x").crossJoin(side("y")).filter("ix < iy")
    may = lambda key: similarity.may_match(F.lit(key), F.col("bx"), F.size("x"), F.col("by"), F.size("y"))
    told = pairs.select(similarity.is_duplicate(F.col("x"), F.col("y")).alias("same"), (similarity.jaccard(F.col("x"), F.col("y")) >= 0.4).alias("alike"),
                        may("0/0|w").alias("word"), may("$|$5B|nvidia").alias("couple")).collect()
    assert all(r["couple"] for r in told) and all(r["word"] for r in told if r["alike"]) and any(r["same"] and not r["alike"] for r in told)
    assert sum(r["word"] for r in told) < 0.3 * len(told)


def test_keys_grow_linearly(spark):
    sizes = [5, 50, 500, 5000]
    df = spark.createDataFrame([(0, str(n), n, [f"t{i}" for i in range(n)]) for n in sizes], "group int, set_id string, ord int, tokens array<string>")
    counts = {r["set_id"]: r["count"] for r in similarity.join_keys(df).groupBy("set_id").count().collect()}
    assert counts["5000"] < 12 * 5000 and counts["500"] < 12 * 500


def test_dedup_blocks_follow_priority(spark):
    cols = "as_of int, block string, region string, pos int, headline string, body string"
    rows = [(1, "regional_tech", "japan", 1, "Nvidia Tokyo Fab", ""), (1, "macro", None, 9, "Nvidia Tokyo Fab", ""), (1, "weekend_reads", None, 2, "Nvidia Tokyo Fab", ""),
            (1, "regional_tech", "taiwan", 5, "Foxconn Ohio Plant", ""), (1, "regional_tech", "japan", 0, "Foxconn Ohio Plant", ""), (2, "macro", None, 1, "Nvidia Tokyo Fab", "")]
    got = {(r["as_of"], r["block"], r["region"], r["pos"]) for r in news.dedup(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(1, "macro", None, 9), (1, "weekend_reads", None, 2), (1, "regional_tech", "taiwan", 5), (2, "macro", None, 1)}


def test_cleaning_counts(spark):
    cols = "block string, source_date string, headline string, body string"
    rows = [("macro", "2024-01-01", "費半大跌 4%", "x"), ("macro", "2024-06-02", "費半大跌 4%", "x"), ("weekend_reads", "2024-01-01", "ok", "股價大漲 5%。好"), ("macro", "bad", "芯片", "平")]
    flagged = news.cleaning_flags(spark.createDataFrame(rows, cols), F.lit("2024-06-01"))
    assert news.quality_counters(flagged).first()[:] == (1, 1, 1)
    kept = news.clean(spark.createDataFrame(rows, cols), F.lit("2024-06-01")).collect()
    assert [(r["headline"], r["body"]) for r in kept] == [("ok", "好"), ("晶片", "平")]


def test_block_caps(spark):
    df = spark.createDataFrame([(1, b, r, p) for b, r in (("regional_tech", "us"), ("regional_tech", "japan"), ("world_news", None), ("other", None)) for p in range(5)],
                               "as_of int, block string, region string, pos int")
    got = news.cap_blocks(df).groupBy("block", "region").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("regional_tech", "us"): 3, ("regional_tech", "japan"): 3, ("world_news", None): 3, ("other", None): 5}
