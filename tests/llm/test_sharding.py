import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from barline.llm import sharding


def draw(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def jump(key, n):
    at, after = -1, 0
    while after < n:
        at = after
        after = (at + 1) * 2**31 // ((draw(f"{key}:{at}") >> 1) + 1)
    return at


def test_matches_the_walk(spark):
    rows = [(i, "é" * i) for i in range(500)] + [(3, "again"), (None, None), (None, None), (600, "")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(1))).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump("" if i is None else i, 16), jump("" if i is None else i, 17)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)


def test_moves_only_what_it_must(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(*(sharding.jump(F.col("k"), n).alias(f"s{n}") for n in (1, 7, 8))).collect()
    assert {r.s1 for r in rows} == {0}
    moved = [r for r in rows if r.s7 != r.s8]
    assert all(r.s8 == 7 for r in moved) and abs(len(moved) - 20_000 / 8) < 250
    assert all(abs(n - 2500) < 250 for n in Counter(r.s8 for r in rows).values())


def test_empty(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []
