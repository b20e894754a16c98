import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from barline.operators import ranking, series
from barline.plans import screener


def rows(n=400, seed=1):
    rng = random.Random(seed)
    # a third of all values are equal: one hot level
    return [(rng.choice("ab"), f"t{i:04d}", None if i % 17 == 0 else (0.0 if i % 3 == 0 else round(rng.uniform(-9, 9), 2)))
            for i in range(n)]


def test_percents_match_counting(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, t string, v double")
    got = {r["t"]: r["p"] for r in ranking.percents_at_or_below(df, ["g"], {"v": "p"}, ["t"]).collect()}
    whole = {r["t"]: r["p"] for r in ranking.percents_at_or_below(df, [], {"v": "p"}, ["t"]).collect()}
    for g, t, v in data:
        if v is None:
            assert got[t] is None and whole[t] is None
            continue
        for percent, pool in ((got[t], [x for gg, _, x in data if gg == g and x is not None]), (whole[t], [x for *_, x in data if x is not None])):
            assert abs(percent - sum(x <= v for x in pool) / len(pool) * 100) <= 0.05 + 1e-9
    assert max(v for v in got.values() if v is not None) == 100.0


def test_position_matches_sorting(spark):
    data = rows() + [("a", "u1", 1e12), ("a", "u2", -1e12), ("b", "u3", 0.0), ("b", "u4", -0.004), ("b", "u5", 1e-9)]
    df = spark.createDataFrame(data, "g string, t string, v double")
    key = lambda r: (r[2] is None, -(r[2] or 0.0), r[1])
    whole = {r["t"]: r["rank"] for r in ranking.position(df, [], "v", ["t"]).collect()}
    assert whole == {r[1]: n for n, r in enumerate(sorted(data, key=key), 1)}
    inside = {r["t"]: r["rank"] for r in ranking.position(df, ["g"], "v", ["t"]).collect()}
    assert inside == {r[1]: n for g in "ab" for n, r in enumerate(sorted((x for x in data if x[0] == g), key=key), 1)}


def test_slices_keep_the_order(spark):
    rng = random.Random(3)
    values = sorted(rng.choice((1, -1)) * 10 ** rng.uniform(-6, 20) for _ in range(2000))
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").orderBy("v").select(ranking.slice_of(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) > 500


def test_no_task_holds_a_group(spark):
    df = spark.createDataFrame(rows(), "g string, t string, v double")
    plan = ranking.position(df, [], "v", ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_slice" in plan and plan.count("SinglePartition") == 1  # the offsets only


def test_input_order_does_not_matter(spark):
    data = rows()
    out = []
    for seed in (1, 2):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "g string, t string, v double")
        out.append({r["t"]: r["p"] for r in ranking.percents_at_or_below(df, ["g"], {"v": "p"}, ["t"]).collect()})
    assert out[0] == out[1]


def test_first_k_cuts_before_the_shuffle(spark):
    df = spark.createDataFrame(rows(), "g string, t string, v double")
    plan = ranking.first_k(df, ["g"], [F.col("t")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rank_labels(spark):
    df = spark.createDataFrame([(5, 3), (3, 5), (4, 4), (None, 1)], "p int, c int")
    d = ranking.rank_delta(F.col("p"), F.col("c"))
    assert [r[0] for r in df.select(ranking.rank_delta_label(d)).collect()] == ["↑2", "↓2", "—", "新進"]


def test_percents_in_place_are_those_of_the_ladder(spark):
    data = rows() + [("a", "n1", float("nan")), ("a", "n2", float("nan")), ("b", "z1", -0.0), ("b", "z2", 0.0), ("b", "i", float("inf")), ("c", "x", None)]
    df = spark.createDataFrame(data, "g string, t string, v double")
    ladder = {r["t"]: r["p"] for r in ranking.percents_at_or_below(df, ["g"], {"v": "p"}, ["t"]).collect()}
    assert {r["t"]: r["p"] for r in ranking.percents_in_place(df, ["g"], {"v": "p"}).collect()} == ladder


def test_sessions_are_ranked_where_their_spans_arrive(spark):
    """A bar is moved once a block of days, not once a session and column, and what comes out is the fill and its shares."""
    rng, first = random.Random(6), date(2024, 1, 1)
    bars = [(f"t{t}", first + timedelta(days=d), rng.uniform(5, 9)) for t in range(9) for d in range(0, 420) if rng.random() < (0.02 if t > 6 else 0.5)]
    df = spark.createDataFrame([b for b in bars if b[0] != "t3" or b[1] < date(2024, 1, 30)], "ticker string, dt date, close double")
    out = screener.rs_at_sessions(df, screener.session_numbers(series.sessions(df)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and not re.search(r"hashpartitioning\(as_of#\d+, [a-z]", plan)
    ret = {}
    for r in series.lookback_returns(df).collect():
        ret.setdefault(r["ticker"], {})[r["dt"]] = r
    want = {}
    for day in {b.dt for b in df.collect()}:
        held = {t: max(d for d in by if d <= day) for t, by in ret.items() if any(d <= day for d in by)}
        alive = {t: ret[t][d] for t, d in held.items() if (day - d).days <= series.PANEL_DAYS}
        for t, row in alive.items():
            pool = [x["ret_4w"] for x in alive.values() if x["ret_4w"] is not None]
            n = sum(x <= row["ret_4w"] for x in pool) if row["ret_4w"] is not None else None
            want[t, day] = (row["close"], None if n is None else (n * 2000 + len(pool)) // (len(pool) * 2) / 10)
    assert {(r["ticker"], r["as_of"]): (r["close"], r["raw_4w"]) for r in out.collect()} == want
