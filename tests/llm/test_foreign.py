"""Documents in a language that nothing was learned from are rejected, others are not."""

from pyspark.sql import functions as F

from barline.llm import language


def test_one_language_left_out_of_learning(spark, sf):
    docs = spark.read.parquet(f"{sf.removesuffix('0.001')}0.01/documents.parquet").select("doc_id", "text", F.col("lang").alias("true"))
    for left_out in ("de", "fr"):
        frame = docs.withColumn("lang", F.when(F.col("true") != left_out, F.col("true")))
        found = language.predict(frame).cache()
        good = {r.doc_id for r in language.accepted(found).collect()}
        rows = found.select("doc_id", "true", "n_grams").collect()
        found.unpersist()
        foreign = [r.doc_id in good for r in rows if r.true == left_out and r.n_grams >= 512]
        assert len(foreign) >= 50 and sum(foreign) <= 0.2 * len(foreign)
        assert all(r.doc_id in good for r in rows if r.true != left_out and r.n_grams)


def test_few_learned_texts_get_the_fixed_bound(spark):
    df = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert language.bounds(language.predict(df)) == [language.REJECT] * 64
    assert language.accepted(language.predict(df)).count() == 9
