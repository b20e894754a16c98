import corpus_pipeline
import twins
from barline.llm import pieces, vocab


def test_stages_match_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    cut = twins.kept_lines(docs)
    docs = {i: t for i, t in cut.items() if t == docs[i] or twins.spaced(t)}
    root = twins.near_documents(docs)
    docs = {i: t for i, t in docs.items() if root[i][1] == i}
    hits = twins.contaminated(docs, items)
    docs = {i: twins.cut_words(t, hits[i][1]) for i, t in docs.items() if not hits[i][1] or len(hits[i][1]) < hits[i][0]}
    model = pieces.processor(vocab.path("piece_bpe_32k.model"))
    want = sorted((i, model.encode(t), model.decode(model.encode(t))) for i, t in docs.items())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r["ids"], r.decoded) for r in got) == want
    assert all(r.n_tokens == len(r["ids"]) for r in got)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf):
    rows = [(1, "the of and in to a that it was for on are with as this be at", "en", "s", 3, "x"), (2, None, None, None, None, None), (None, "the of and", "en", "s", 1, "y"), (4, "!!", "en", "s", 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, SCORE string")
    docs = docs.selectExpr("*", "1 as spans", "2 as n_lines", "3 as _gone", "4 as items")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert out.columns == docs.columns and out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf).count() == frame.count()
    assert len(corpus_pipeline.STAGES) == 5
