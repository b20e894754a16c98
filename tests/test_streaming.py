import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from barline.operators import smoothing
from barline.streaming import jobs


def in_batches(spark, frames, folder):
    """One file per micro-batch, in order."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{folder}/part{i}")
    return frames[0].schema


def nested_stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_title_dedup_over_batches(spark, tmp_path):
    now = datetime(2024, 6, 3, 12)
    rows = [("Big News!", now), ("big news", now + timedelta(hours=1)), ("Other", None), ("other?", None), ("Big  news", now + timedelta(hours=2))]
    frames = [spark.createDataFrame(part, "title string, published timestamp") for part in (rows[:2], rows[2:])]
    schema = in_batches(spark, frames, tmp_path)
    out = jobs.run_available(jobs.dedup_titles(nested_stream(spark, schema, tmp_path)), "t")
    assert sorted(r["title_key"] for r in out.collect()) == ["bignews", "other"]


def test_latest_two_split_equals_whole(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ABC"), datetime(2024, 1, 1) + timedelta(minutes=i), None if i % 9 == 0 else float(i)) for i in range(120)]
    rng.shuffle(rows)
    frames = [spark.createDataFrame(rows[i::3], "symbol string, ts timestamp, close double") for i in range(3)]
    schema = in_batches(spark, frames, tmp_path)
    table = jobs.run_available(jobs.latest_two(nested_stream(spark, schema, tmp_path)), "l")
    got = {r["symbol"]: (r["latest"], r["previous"], r["n_seen"]) for r in jobs.newest_state(table).collect()}
    for s in "ABC":
        mine = sorted((ts, c) for k, ts, c in rows if k == s and c is not None)
        assert got[s] == (mine[-1][1], mine[-2][1], len(mine))


def state_rows(spark, folder, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{folder}/state")


def test_latest_two_state_is_bounded(spark, tmp_path):
    rows = [(s, datetime(2024, 1, 1) + timedelta(minutes=i), float(i)) for i in range(200) for s in "AB"]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:150] + [(None, rows[0][1], 1.0), ("C", None, 1.0)], rows[150:]):
        spark.createDataFrame(part, "symbol string, ts timestamp, close double").write.mode("append").parquet(source)
        table = jobs.run_available(jobs.latest_two(spark.readStream.schema("symbol string, ts timestamp, close double").parquet(source)), "l", out)
    assert state_rows(spark, out, "closes").count() == 4
    assert {(r["symbol"], r["latest"], r["previous"], r["n_seen"]) for r in jobs.newest_state(table).collect()} == {("A", 199.0, 198.0, 200), ("B", 199.0, 198.0, 200)}


def test_smooth_state_goes_on_from_a_snapshot(spark, tmp_path):
    cols = "ticker string, seq int, raw_1w double, raw_4w double, raw_13w double"
    rng = random.Random(8)
    rows = [(t, s, *[rng.randint(0, 1000) / 10 for _ in range(3)]) for t in "abc" for s in range(1, 21)]
    whole = spark.createDataFrame(rows, cols)
    smoothing.write_states(smoothing.smooth_history(whole.filter("seq <= 12 AND ticker <> 'c'")), str(tmp_path / "kept"), 12)
    seq, start = smoothing.states_before(spark, str(tmp_path / "kept"), 13)
    late = spark.createDataFrame([("a", 12, 1.0, 1.0, 1.0), ("a", 3, 1.0, 1.0, 1.0), ("b", 14, None, 1.0, 1.0)], cols)
    (whole.filter("seq > 12").unionByName(late)).write.parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.smooth_states(spark.readStream.schema(cols).parquet(str(tmp_path / "in")), start), "s").collect()
    want = {(r["ticker"], r["seq"]): [r[c] for c in smoothing.SMOOTH]
            for r in smoothing.smooth_history(whole.filter("seq > 12 OR ticker <> 'c'")).filter("seq > 12").collect()}
    assert seq == 12 and {(r["ticker"], r["seq"]): [r[c] for c in smoothing.SMOOTH] for r in out} == want
    assert {(r["ticker"], r["late"]) for r in out} == {("a", 2), ("b", 0), ("c", 0)}


def test_smooth_state_equals_fold_and_drops_late(spark, tmp_path):
    cols = "ticker string, seq int, raw_1w double, raw_4w double, raw_13w double"
    rng = random.Random(6)
    rows = [(t, s, *[rng.randint(0, 1000) / 10 for _ in range(3)]) for t in "ab" for s in range(1, 31) if (t, s) not in {("a", 7), ("b", 20)}]
    late = [("a", 3, 99.0, 99.0, 99.0)]
    frames = [spark.createDataFrame(part, cols) for part in ([r for r in rows if r[1] <= 10], [r for r in rows if r[1] > 10] + late)]
    schema = in_batches(spark, frames, tmp_path)
    out = jobs.run_available(jobs.smooth_states(nested_stream(spark, schema, tmp_path)), "s")
    key = lambda df: {(r["ticker"], r["seq"]): (r["rs_1w"], r["rs_4w"], r["rs_13w"]) for r in df.collect()}
    assert key(out) == key(smoothing.smooth_history(spark.createDataFrame(rows, cols)))


def one_by_one(triggers):
    """What each name's snapshots come to, one name and one snapshot at a time."""
    last, late, out = {}, {}, []
    for rows in triggers:
        for name, seq, *raw in sorted((r for r in rows if None not in r), key=lambda r: r[:2]):
            if name in last and seq <= last[name][0]:
                late[name] = late.get(name, 0) + 1
                continue
            follows = name in last and seq == last[name][0] + 1
            tenths = [round(10 * x) for x in raw]
            last[name] = [seq, *[(8 * p + 2 * r + 5) // 10 if follows else r for p, r in zip(last[name][1:] if follows else tenths, tenths)]]
            out.append((name, seq, *[x / 10 for x in last[name][1:]], late.get(name, 0)))
    return sorted(out)


def test_smooth_states_of_many_names_share_a_call(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 3)
    cols = "ticker string, seq int, raw_1w double, raw_4w double, raw_13w double"
    rng = random.Random(5)
    row = lambda name, seq: (name, seq, *[rng.randint(0, 1000) / 10 for _ in range(3)])
    first = [row(f"n{n}", seq) for n in range(40) for seq in range(1, n + 2) if rng.random() < 0.9]
    second = [row(f"n{n}", seq) for n in range(20, 50) for seq in range(max(n - 3, 1), n + 6)] + [("n1", 9, None, 1.0, 1.0), (None, 9, 1.0, 1.0, 1.0)]
    third = [(f"n{n}", 1, 5.0, 5.0, 5.0) for n in range(30, 40)] + [(name, 60, 7.0, 8.0, 9.0) for name in ("n3", "n3", "n60")]  # late ones, one twice
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (first, second, third):
        rng.shuffle(rows)
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(source)
        table = jobs.run_available(jobs.smooth_states(spark.readStream.schema(cols).parquet(source)), "s", out)
    assert sorted(tuple(r) for r in table.select("ticker", "seq", *smoothing.SMOOTH, "late").collect()) == one_by_one((first, second, third))
    assert state_rows(spark, out, "last").select("key").distinct().count() == 3


def test_tumbling_bars_wait_for_the_watermark(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("A", start + timedelta(hours=h), h, float(10 + h % 5), 1) for h in range(60)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, seq int, price double, volume int")
    schema = in_batches(spark, [frame], tmp_path)
    out = jobs.run_available(jobs.tumbling_bars(nested_stream(spark, schema, tmp_path)), "b").orderBy("start").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in out] == [(10.0, 14.0, 10.0, 13.0, 24), (14.0, 14.0, 10.0, 12.0, 24)]


def test_gated_runs_take_each_file_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    item = lambda title: spark.createDataFrame([(title,)], "title string").write.mode("append").json(source)
    friday, sunday, monday = (pd.Timestamp(f"2024-06-{d:02d} 03:00") for d in (7, 9, 10))
    item("first")
    assert jobs.take_new_files(spark, source, out, friday).count() == 1
    item("second")
    assert jobs.take_new_files(spark, source, out, sunday) is None
    got = jobs.take_new_files(spark, source, out, monday).collect()
    assert sorted((r["title"], r["run_at"].day) for r in got) == [("first", 7), ("second", 10)]
    assert jobs.take_new_files(spark, source, out, monday).count() == 2  # nothing new


def test_schedule_gate(spark):
    ran = []
    job = lambda: ran.append(1)
    jobs.run_if_due(job, pd.Timestamp("2024-06-08 20:00"), screen=False)  # Sunday in the desk zone
    jobs.run_if_due(job, pd.Timestamp("2024-06-09 20:00"), screen=True)   # Monday there
    assert ran == []
    jobs.run_if_due(job, pd.Timestamp("2024-06-09 20:00"))
    jobs.run_if_due(job, pd.Timestamp("2024-06-10 20:00"), screen=True)
    assert ran == [1, 1]
    days = spark.sql("SELECT * FROM VALUES (date'2024-06-09'), (date'2024-06-10'), (date'2024-06-11') t(d)")
    assert [tuple(r) for r in days.select(jobs.is_run_day(F.col("d")), jobs.is_run_day(F.col("d"), True)).collect()] == [(False, False), (True, False), (True, True)]


def test_a_table_of_several_files_is_read_whole(spark, sf, tmp_path):
    from barline.catalog import streams

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    keys = lambda folder: sorted(r[0] for r in streams.stream_title_dedup(spark, folder).collect())
    assert keys(str(tmp_path)) == keys(sf) != []
