import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import entry, packing, vocab

PATH = vocab.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs, library, room=2048):
    """Every id in one piece, gapless pieces and offsets, sizes within the room; gives the share of padding."""
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(ids_of(library, text))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (i, n), found in pieces.items():
        texts = [x for x in want[i] if len(x) == n]
        assert sorted(r.start for r in found)[:: len(texts)] == sorted({r.start for r in found}) or len(texts) > 1
        for r in found:
            sums = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in texts}
            assert r.ids_crc32 in sums and r.length > 0
        assert sum(r.length for r in found) == n * len(texts)
    assert sum(r.length for r in rows) == sum(len(x) for t in want.values() for x in t)
    total = pad = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= room
        total += at
        pad += 0 if at & (at - 1) == 0 else room - at
    return pad / max(total, 1)


def test_query_matches_library(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(entry.op12_sequence_packing(spark, sf).collect(), docs, library) < 0.01


def best(at, penalty, room):
    """The least cost, by trying every earlier cut."""
    cost = [0]
    for j in range(1, len(at)):
        tries = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= room:
                tries.append(cost[i] + (0 if n & (n - 1) == 0 else room - n) + penalty[j] + packing.SEQUENCE)
        cost.append(min(tries))
    return cost[-1]


def price(at, penalty, chosen, room):
    sizes = [at[b] - at[a] for a, b in zip(chosen, chosen[1:])]
    return sum((0 if n & (n - 1) == 0 else room - n) + packing.SEQUENCE for n in sizes) + sum(penalty[c] for c in chosen[1:])


def test_plan_is_optimal():
    rng = random.Random(8)
    for _ in range(150):
        room = rng.choice((16, 40, 64))
        at = np.cumsum([0] + [rng.randint(1, room) if rng.random() < 0.2 else rng.randint(1, 6) for _ in range(rng.randint(1, 60))])
        penalty = np.array([0] + [rng.choice((0, 8, 48)) for _ in at[1:]])
        chosen, cost = packing.plan(at, penalty, room)
        assert chosen[0] == 0 and chosen[-1] == len(at) - 1
        assert cost == best(at.tolist(), penalty.tolist(), room) == price(at.tolist(), penalty.tolist(), chosen, room)


def test_cuts_hold_all_ends_and_leave_no_wide_gap():
    at, penalty = packing.cuts(np.array([5000, 5001, 9000]), np.array([40, 80, 5000, 5600]))
    assert {0, 40, 80, 5000, 5001, 5600, 9000} <= set(at.tolist()) and np.diff(at).max() <= packing.GAP
    told = dict(zip(at.tolist(), penalty.tolist()))
    assert (told[5000], told[40], told[144]) == (0, packing.SENTENCE, packing.PLACE)


@pytest.mark.parametrize("segment", [1 << 20, 2048])
def test_segments_long_texts_and_odd_rows(spark, library, segment):
    rng = random.Random(5)
    words = "one two. three! four\n fünf sechs 語語 <|endoftext|> sieben? 8 ".split(" ")
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 400)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 30_000), (103, "word " * 9000), (None, "no id. None"), (7, "again"), (7, "again"), (7, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"LENGTH": F.lit(1), "ids": F.lit("x")}).coalesce(1)
    rows = packing.piece_digests(df, PATH, room=512, segment=segment).collect()
    assert check(rows, docs, library, 512) < 0.03
    packed = packing.pack(df, PATH, room=512, segment=segment).collect()
    assert {(r.sequence_id, p.doc_id, p.start, p.length, p.offset, p.doc_tokens) for r in packed for p in r.pieces} == {
        (r.sequence_id, r.doc_id, r.start, r.length, r.offset, r.doc_tokens) for r in rows}
    assert [i for r in packed for i in r["ids"]] == [i for _, t in docs for i in ids_of(library, t)]
    assert all(r["size"] == (len(r["ids"]) if len(r["ids"]) & (len(r["ids"]) - 1) == 0 else 512) for r in packed)
    told = packing.padding(packing.pack(df, PATH, room=512, segment=segment)).first()
    assert (told.sequences, told.ids) == (len(packed), sum(len(r["ids"]) for r in packed)) and 0 <= told.padding < 0.03 * told.ids
    assert packing.piece_digests(df.limit(0), PATH).collect() == [] and packing.pack(df.limit(0), PATH).collect() == []


def test_order_by_columns(spark, library):
    docs = [(i, f"text number {i}. " * 50) for i in range(40)]
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(3)
    rows = packing.pack(df, PATH, by=["doc_id"]).orderBy("sequence_id").collect()
    assert [p.doc_id for r in rows for p in r.pieces if p.start == 0] == list(range(40))
