import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pathlib import Path

from barline.llm import chunktable, entry, pieces, textkit, tokenfile, vocab

ODD = ["", " ", "  ", "a", "  a  b ", "▁", "a▁▁b", "▁ a ▁", "x\n y\n\n  z", "<s> </s> <unk>", "é́\x00\x01 　 a\tb", "a ", " a", "日本 語 it's 's 've",
       "<0x0A> \n", "a\n b", "a \nb", "a\n  b c", "<|endoftext|> b <|endoftext|>c d<|endoftext|>", " <|endoftext|>", "\x1f a \x1c b", "a\xa0 b \xa0c", "🙂🙂 👩‍👩‍👧 x"]


def mixed(seed, n=400):
    rng = random.Random(seed)
    alphabet = list("ab  \n\té▁'s日🙂1,.") + ["  ", "<|endoftext|>", "word ", " ", "\x1c"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pieces.processor(vocab.path("piece_bpe_32k.model"))


def test_chunk_table_is_the_library(model, monkeypatch):
    texts = ODD + mixed(1, 3000) + ["word " * 50_000, "x" * 5000, "a, b;c (d) 12.5 e\n\n f\ng"]
    for size, slab in ((1_500_000, 1 << 20), (50, 2000)):
        monkeypatch.setattr(pieces.ChunkTable, "limit", size)
        monkeypatch.setattr(pieces, "SLAB", slab)
        table, got = pieces.ChunkTable(vocab.path("piece_bpe_32k.model")), []
        for _, _, ids, at in table.slabs(pa.array(texts)):
            got += [x.tolist() for x in np.split(ids, at[1:-1])]
        assert got == model.encode(texts)


def test_shared_hashes_lose_nothing(model, monkeypatch):
    """Chunks that share the first hash are told apart by the second and segmented by themselves."""
    texts = ["one two three, four. one two", "two three", "", "four one"]
    whole = textkit.hashes
    monkeypatch.setattr(textkit, "hashes", lambda raw, s, e, values: whole(raw, s, e, values) % np.uint64(2 if values is textkit.CASED[0] or values.tolist() == textkit.CASED[0].tolist() else 1 << 62))
    table = pieces.ChunkTable(vocab.path("piece_bpe_32k.model"))
    for _ in range(2):
        (_, _, ids, at), = table.slabs(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, at[1:-1])] == model.encode(texts)


def test_queries_match_the_libraries(spark, sf, model, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.op7_sentencepiece(spark, sf).collect()}
    want = {i: model.encode(t) for i, t in texts.items()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(model.decode(x) if x else "")) for i, x in want.items()}
    files = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in entry.op10_token_files(spark, sf).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 0]
        assert files[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(files) == len(texts)


def test_round_trip_and_digests(spark, model):
    rows = list(enumerate([*ODD, None])) + [(0, "again"), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as IDS")
    got = pieces.round_trip(df, vocab.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id, r["ids"], r.decoded) for r in got) == sorted((i, model.encode(t or ""), model.decode(model.encode(t)) if t else "") for i, t in rows)
    again = pieces.decode(pieces.encode(df, vocab.path("piece_bpe_32k.model")), vocab.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id, r.decoded) for r in again) == sorted((r.doc_id, r.decoded) for r in got)
    assert pieces.digests(df.limit(0), vocab.path("piece_bpe_32k.model")).collect() == []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))


def test_chunk_table_of_files_is_the_library(library, monkeypatch):
    texts = ODD + mixed(2, 1500) + ["word " * 50_000, "été à la\u00a0mer é \u3000x — y 日本 語"]
    want = [[*e.ids, 7, 9] for e in library.encode_batch(texts, add_special_tokens=False)]
    for size, slab in ((1_500_000, 1 << 20), (50, 2000)):
        monkeypatch.setattr(chunktable.ChunkTable, "limit", size)
        table, got = tokenfile.ChunkTable(vocab.path("byte_bpe_50k.json")), []
        for _, _, raw, offsets in textkit.slabs(pa.array(texts), slab):
            ids, n = table.encode(raw, offsets, [7, 9])
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want


def test_files(spark, library, tmp_path):
    rows = [(i * 7 % 300, f"text {i} " * (i % 9)) for i in range(300)] + [(5, "twice"), (5, "twice"), (None, "no id"), (400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part").repartition(5)
    folder = str(tmp_path / "out")
    tokenfile.write_tokens(df, folder, vocab.path("byte_bpe_50k.json"), files=4)
    got = tokenfile.index(spark, folder).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = sorted((str(i), zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    files = sorted(Path(folder).glob("*.parquet"))
    assert len(files) == 4
    meta = pq.read_metadata(files[0]).row_group(0)
    kinds = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in kinds["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings and all(c.has_offset_index for c in kinds.values())


def test_empty_files(spark, tmp_path):
    folder = str(tmp_path / "none")
    tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, vocab.path("byte_bpe_50k.json"))
    assert tokenfile.index(spark, folder).collect() == []
