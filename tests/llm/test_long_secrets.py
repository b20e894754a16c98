"""Values of any length, and dates with the month first."""

import hashlib
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from barline.llm import pseudonyms as P


def permute(value, key):
    """Permutation of a string of small letters, in any length."""
    half = len(value) // 2
    a, b = value[:half], value[half:]
    for k in range(1, P.ROUNDS + 1):
        seed = f"{key}|{k}|{len(value)}|{b}"
        seed = hashlib.sha256(seed.encode()).hexdigest() if len(a) > 128 else seed
        stream = b"".join(hashlib.sha256(f"{seed}|{i}".encode()).digest() for i in range(len(a) // 32 + 1))
        a, b = b, "".join(chr(97 + (ord(c) - 97 + by) % 26) for c, by in zip(a, stream))
    return a + b


def rewrite(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(P.pseudonymize(df, "k").collect(), key=lambda r: r.doc_id)]


def test_secrets_move_to_their_last_character(spark):
    rng = random.Random(5)
    tokens = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (128, 129, 255, 256, 257, 300, 1000, 30_001)]
    hexes = ["".join(rng.choices("0123456789abcdef", k=n)) for n in (64, 65, 128, 700)]
    out = rewrite(spark, [f"token={t} end" for t in tokens] + [f'x "{h}" y' for h in hexes])
    assert out[: len(tokens)] == [f"token={permute(t, 'k|secret')} end" for t in tokens]
    for h, new in zip(hexes, out[len(tokens) :]):
        assert re.fullmatch(f'x "[0-9a-f]{{{len(h)}}}" y', new)
        assert all(new[3 + i : 11 + i] != h[i : i + 8] for i in range(0, len(h) - 7, 8))


def test_month_first_dates_move_among_their_like(spark):
    a, b, bad, day = rewrite(spark, ["on 12/25/2020.", "12/26/2020", "13/32/2020", "25/12/2020"])
    assert re.fullmatch(r"on (0[1-9]|1[0-2])/(1[3-9]|2\d|3[01])/\d{4}\.", a) and a != "on 12/25/2020." and a[3:13] != b
    assert bad == "13/32/2020" and day != "25/12/2020"
    days = [date(1800, 1, 1) + timedelta(i) for i in range(P.DAYS)]
    late = {d for d in days if d.day > 12}
    assert len(late) == P.LATE_DAYS
    df = spark.createDataFrame([(d,) for d in sorted(late)], "d date").repartition(4)
    assert {r.p for r in df.select(P._late(F.col("d"), "q").alias("p")).collect()} == late
