import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barline.operators import contraction, series, smoothing
from barline.plans import screener as scr


# ---- brute force twins, written from the rules -----------------------------

def half_up(x, digits):
    return math.floor(x * 10**digits + 0.5 + 1e-9) / 10**digits


def brute_score(bars):
    close = [b[4] for b in bars]
    mean = lambda xs: sum(xs) / len(xs)
    points = 20 if close[-1] > mean(close[-150:]) > mean(close[-200:]) else 0
    view = bars[-90:]
    peaks = []
    for i in range(10, len(view) - 5):
        if view[i][2] != max(b[2] for b in view[i - 10:i + 6]):
            continue
        if peaks and i - peaks[-1] < 10:
            if view[i][2] > view[peaks[-1]][2]:
                peaks[-1] = i
        else:
            peaks.append(i)
    legs = []
    for a, b in zip(peaks, peaks[1:]):
        at = min(range(a, b), key=lambda j: (view[j][3], j))
        depth = (view[a][2] - view[at][3]) / view[a][2] * 100
        if depth >= 3:
            legs.append((depth, view[at][3], mean([v[5] for v in view[a:at + 1]])))
    n = len(legs)
    points += {0: 0, 1: 8}.get(n, 20 if n <= 4 else 10)
    rising = None
    if n >= 2:
        pairs = list(zip(legs, legs[1:]))
        rising = all(y[1] > x[1] for x, y in pairs)
        points += 15 * all(y[0] < x[0] for x, y in pairs) + 15 * rising + 10 * all(y[2] < x[2] for x, y in pairs)
    if legs:
        points += 15 if legs[-1][0] < 4 else 10 if legs[-1][0] < 6 else 5 if legs[-1][0] < 10 else 0
    if peaks:
        top = view[peaks[-1]][2]
        gap = (top - close[-1]) / top * 100
        points += 15 if gap < 3 else 10 if gap < 5 else 5 if gap < 10 else -5
    ranges = [max(b[2] - b[3], *([abs(b[2] - p[4]), abs(b[3] - p[4])] if p else [0])) for p, b in zip([None, *bars], bars)]
    squeeze = mean(ranges[-10:]) / mean(ranges[-60:])
    points += 10 if squeeze < 0.5 else 5 if squeeze < 0.7 else 0
    return max(0, min(100, points)), n, rising


def walk(seed, n, step):
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        drift = 0.2 * math.cos(i / 7) * step
        price *= 1 + rng.gauss(0.0005, 0.004 * step) + drift / 100
        # rounding makes equal highs and lows common
        out.append((f"s{seed}", date(2020, 1, 1) + timedelta(days=i), round(price * 1.01, 1), round(price * 0.99, 1), round(price, 2), float(rng.randint(1, 9))))
    return out


def test_contraction_matches_brute_force(spark):
    data = [row for seed in range(40) for row in walk(seed, 149 + seed * 3, 0.5 + seed % 5)]
    bars = spark.createDataFrame(data, "ticker string, dt date, high double, low double, close double, volume double")
    ends = [date(2020, 1, 1) + timedelta(days=149 + k) for k in (0, 40)]
    got = {(r["ticker"], r["as_of"]): r for r in contraction.contraction_score(bars, ends).collect()}
    checked = 0
    for seed in range(40):
        mine = [r for r in data if r[0] == f"s{seed}"]
        for end in ends:
            seen = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in mine if r[1] <= end]
            key = (f"s{seed}", end)
            if len(seen) < 150:
                assert key not in got
                continue
            points, n, rising = brute_score(seen)
            assert (got[key]["contraction_score"], got[key]["vcp_pullback_count"], got[key]["rising_lows"]) == (points, n, rising), key
            assert (got[key]["ma200"] is None) == (len(seen) < 200)
            checked += 1
    assert checked > 70 and len({got[k]["vcp_pullback_count"] for k in got}) >= 4


def test_close_highs_merge(spark):
    arr = "array<struct<i:int,v:double>>"
    df = spark.createDataFrame([([(1, 5.0), (5, 7.0), (14, 6.0), (15, 7.5), (30, 7.5), (39, 7.5)],), ([],)], f"h {arr}")
    got = [[(x["i"], x["v"]) for x in r[0]] for r in df.select(contraction.merge_close_highs(F.col("h"))).collect()]
    assert got == [[(5, 7.0), (15, 7.5), (30, 7.5)], []]


def loop(rows):
    out, last = {}, None
    for seq, *raw in sorted(rows):
        tenth = [round(x * 10) for x in raw]
        now = [(8 * p + 2 * x + 5) // 10 for p, x in zip(last[1], tenth)] if last and last[0] == seq - 1 else tenth
        out[seq] = [x / 10 for x in now]
        last = (seq, now)
    return out


def test_smoothing_matches_loop_and_restarts(spark):
    rng, data = random.Random(3), []
    for t in range(5):
        for seq in range(1, 131):
            if rng.random() > 0.06:  # gaps restart the chain
                data.append((f"t{t}", seq, *[rng.randint(0, 1000) / 10 for _ in range(3)]))
    df = spark.createDataFrame(data, "ticker string, seq int, raw_1w double, raw_4w double, raw_13w double")
    want = {(t, s): v for t in {d[0] for d in data} for s, v in loop([d[1:] for d in data if d[0] == t]).items()}
    got = {(r["ticker"], r["seq"]): [r["rs_1w"], r["rs_4w"], r["rs_13w"]] for r in smoothing.smooth_history(df).collect()}
    assert got == want
    tail = smoothing.smooth_history(df, keep_last=2).collect()
    assert {(r["ticker"], r["seq"]): [r["rs_1w"], r["rs_4w"], r["rs_13w"]] for r in tail}.items() <= want.items()
    assert len(tail) == 10


def test_daily_step_equals_history(spark):
    data = [("a", 1, 10.0, 20.0, 30.0), ("a", 2, 50.3, 60.1, 70.7), ("b", 2, 5.0, 6.0, 7.0)]
    df = spark.createDataFrame(data, "ticker string, seq int, raw_1w double, raw_4w double, raw_13w double")
    previous = spark.createDataFrame([("a", 10.0, 20.0, 30.0), ("b", None, None, None)], "ticker string, rs_1w double, rs_4w double, rs_13w double")
    got = {r["ticker"]: r["rs_1w"] for r in smoothing.smooth_once(df.filter("seq = 2"), previous).collect()}
    assert got == {"a": 18.1, "b": 5.0}


# ---- screens and picks -----------------------------------------------------

COLS = ("as_of date, ticker string, rs_score double, contraction_score double, combined_score double, rs_trend string, dist_from_high_pct double, "
        "volume_ratio double, vcp_pullback_count int, last_pullback_pct double, rising_lows boolean, vs_200ma_pct double, rank int, rank_change int")


def ranked(spark, rows):
    base = [date(2024, 1, 1)]
    return spark.createDataFrame([tuple(base + list(r)) for r in rows], COLS)


def brute_picks(rows):
    keys = ["ticker", "rs", "vcp", "comb", "trend", "dist", "vol", "n", "last", "rise", "ma", "rank", "chg"]
    rows = sorted((dict(zip(keys, r)) for r in rows), key=lambda r: r["rank"])
    up = "加速上升"
    tests = [
        lambda r: r["rs"] >= 80 and r["vcp"] >= 75 and r["trend"] == up and (99 if r["dist"] is None else r["dist"]) < 5 and (r["vol"] or 1) < 0.8,
        lambda r: r["rs"] >= 80 and r["vcp"] >= 75 and r["trend"] == up and (99 if r["dist"] is None else r["dist"]) < 8,
        lambda r: r["rs"] >= 78 and r["vcp"] >= 70 and r["trend"] in (up, "穩定維持"),
        lambda r: r["rs"] >= 75 and r["vcp"] >= 65,
    ]
    pool = next((p for p in ([r for r in rows if t(r)] for t in tests) if p), [])
    lists = {
        "minervini": sorted(pool, key=lambda r: -r["comb"]),
        "momentum": sorted([r for r in rows if (r["chg"] or 0) > 0 and r["rs"] >= 65], key=lambda r: -r["chg"]),
        "vcp": sorted([r for r in rows if r["vcp"] >= 75 and r["rs"] >= 70], key=lambda r: -round(r["vcp"] * 0.7 + r["rs"] * 0.3, 4)),
    }
    spare = {"momentum": lists["momentum"], "vcp": [r for r in rows if r["vcp"] >= 75 and r["rs"] >= 70], "minervini": []}
    out = {}
    for name, choices in lists.items():
        for r in choices[:1] + spare[name]:
            if r["ticker"] not in out.values():
                out[name] = r["ticker"]
                break
    return out


def test_picks_match_brute_force(spark):
    rng = random.Random(9)
    for trial in range(6):
        low = 60 if trial < 4 else 78
        rows = []
        for i in range(12):
            rs, vcp = float(rng.randint(low, 99)), float(rng.randint(low, 99))
            rows.append((f"t{i:02d}", rs, vcp, round(rs * 0.6 + vcp * 0.4, 1), rng.choice(["加速上升", "穩定維持", "震盪"]), rng.choice([None, 0.0, 2.0, 6.0, -1.0]),
                         rng.choice([None, 0.5, 1.2]), 2, 5.0, True, 3.0, i + 1, rng.choice([None, 0, 3, 7, -2])))
        got = {r["direction"]: r["ticker"] for r in scr.top_picks(ranked(spark, rows)).collect()}
        assert got == brute_picks(rows), trial


def test_no_picks_and_reason(spark):
    weak = [("w", 10.0, 10.0, 10.4, "震盪", None, None, 0, None, None, None, 1, None)]
    assert scr.top_picks(ranked(spark, weak)).count() == 0
    assert ranked(spark, weak).select(scr.pick_reason()).first()[0] == "綜合分 10"
    strong = [("s", 91.0, 80.0, 86.6, "加速上升", 2.0, 0.7, 3, 5.5, True, 4.0, 1, 6)]
    assert ranked(spark, strong).select(scr.pick_reason()).first()[0] == "RS 91、RS加速上升、VCP 80、3次收縮、底部抬高"


def test_zero_distance_counts_as_near_unless_strict(spark):
    row = [("z", 85.0, 80.0, 83.0, "加速上升", 0.0, 0.5, 2, 5.0, True, 1.0, 1, None)]
    assert ranked(spark, row).select(scr.setup_tier(), scr.setup_tier(strict_reference=True)).first()[:] == (1, 3)


@pytest.mark.parametrize("r,label,score", [((90, 80, 70), "加速上升", 82.0), ((80, 80, 70), "穩定維持", 77.0), ((70, 80, 90), "開始衰退", 78.0), ((80, 90, 70), "震盪", 78.0), ((100, 99, 98), "加速上升", 100.0)])
def test_trend_and_bonus(spark, r, label, score):
    df = spark.createDataFrame([tuple(float(x) for x in r)], "rs_1w double, rs_4w double, rs_13w double")
    row = scr.rs_fields(df).first()
    assert (row["rs_trend"], row["rs_score"]) == (label, score)


def test_first_snapshot_has_no_change(spark):
    df = spark.createDataFrame([("a", 1)], "ticker string, rank int")
    row = scr.with_rank_change(df, None).first()
    assert (row["rank_change"], row["rank_change_str"]) == (None, "—")


def test_kept_states_restart_anywhere(spark, tmp_path):
    """Sessions appended one by one, run again, or started long ago come to what one run over all of them does."""
    rng = random.Random(4)
    rows = [(t, k, *[round(rng.uniform(0, 100), 1) for _ in range(3)]) for t in ("A", "B", "C") for k in range(1, 121)
            if not (t == "B" and k in (40, 41, 100)) and not (t == "C" and k < 97)]
    df = spark.createDataFrame(rows, "ticker string, seq int, raw_1w double, raw_4w double, raw_13w double")
    key = lambda out: {(r.ticker, r.seq): (r.rs_1w, r.rs_4w, r.rs_13w) for r in out.collect()}
    whole = key(smoothing.smooth_history(df))
    folder = str(tmp_path / "states")
    spark.createDataFrame([], smoothing.STATE).write.partitionBy("seq").parquet(folder)
    assert smoothing.states_before(spark, folder, 99)[0] == 0
    got = {}
    for low, high in ((0, 99), (99, 100), (100, 101), (101, 120), (100, 101)):
        seq, start = smoothing.states_before(spark, folder, low + 1)
        out = smoothing.smooth_history(df.filter((df.seq > seq) & (df.seq <= high)), start=start)
        got |= key(out)
        smoothing.write_states(out, folder, high)
    assert got == whole
    assert smoothing.states_before(spark, folder, 60)[0] == 48
    assert {r.seq for r in spark.read.parquet(folder).select("seq").distinct().collect()} == {48, 96, 99, 100, 101, 120}


def test_newest_snapshots_are_told_from_those_before(spark):
    """From any number on, a settled row is that of the whole history; a share that stands still settles nothing."""
    rng, day = random.Random(6), date(2024, 1, 1)
    rows = [(t, k, day + timedelta(days=k), *[rng.randint(0, 1000) / 10 if t != "still" else 40.0 for _ in range(3)])
            for t in ("a", "b", "c", "gap", "new", "still", "none") for k in range(1, 161) if not (t == "gap" and k in (150, 159)) and not (t == "new" and k < 155)]
    rows = [r if r[0] != "none" or r[1] != 157 else (*r[:3], None, r[4], r[5]) for r in rows]
    df = spark.createDataFrame(rows, "ticker string, seq int, as_of date, raw_1w double, raw_4w double, raw_13w double")
    wanted = [day + timedelta(days=159), day + timedelta(days=160)]
    key = lambda out: {(r.ticker, r.seq): (r.as_of, r.rs_1w, r.rs_4w, r.rs_13w) for r in out.collect()}
    whole = key(smoothing.smooth_history(df, None, ("as_of",)).filter(F.col("as_of").isin(wanted)))
    for before in (0, 20, 140, 157):
        out = smoothing.smooth_newest(df.filter(F.col("seq") > before), wanted, before, ("as_of",))
        settled = key(out.filter("settled"))
        assert settled.items() <= whole.items() and len(key(out)) == len(whole) == 13
        names = {t for t, _ in settled}
        assert "gap" in names and ("still" in names) == (before == 0) and ("new" in names or before > 154)
        assert before > 20 or {"a", "b", "c", "none"} <= names
        assert before < 157 or "a" not in names


@pytest.mark.parametrize("width,tries", [(90, 1), (3, 4)])
def test_newest_strength_reads_few_sessions(spark, monkeypatch, width, tries):
    """The newest sessions come to what the whole history has for them, and only as many are ranked as that takes."""
    rng = random.Random(8)
    bars = [(f"t{t}", date(2024, 1, 1) + timedelta(days=d), rng.uniform(5, 50)) for t in range(12) for d in range(260) if t or d % 3]
    df = spark.createDataFrame(bars, "ticker string, dt date, close double")
    days = scr.newest_sessions(df, 2)
    whole = scr.rs_history(df, min_bars=70).filter(F.col("as_of").isin(days))
    asked, at_sessions = [], scr.rs_at_sessions
    monkeypatch.setattr(scr, "rs_at_sessions", lambda bars, calendar: asked.append(calendar.count()) or at_sessions(bars, calendar))
    monkeypatch.setattr(smoothing, "WINDOW", width, raising=False)
    got = scr.rs_history(df, days, min_bars=70)
    key = lambda out: sorted(tuple(r) for r in out.select("ticker", "seq", "as_of", *smoothing.SMOOTH, "close", "ret_13w").collect())
    assert key(got) == key(whole) and len(key(got)) == 24
    assert asked[0] == width + 2 and len(asked) <= tries and max(asked) < 260
    assert key(scr.rs_history(df, days, min_bars=70, days=series.sessions(df))) == key(whole)
