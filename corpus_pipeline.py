"""Cleaning of a document corpus in five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a table; all but the last give the columns of `documents`. `run` writes
each stage's table as Parquet to the shared folder of the session and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import fmindex, jaccard, language, lines, pieces, vocab
from barline.llm.store import packed, saved, unpacked


def _measured(docs: DataFrame) -> DataFrame:
    """Keep the length column true to a text that was cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in none of the languages that the labelled documents teach, go."""
    found = language.predict(packed(docs, "doc_id", "text", "lang"))
    return unpacked(language.accepted(found), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals are cut; documents that lost all their lines go."""
    found = lines.dedup_lines(packed(docs, "doc_id", "text"))
    return _measured(unpacked(lines.with_content(found), docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches that benchmark items share are cut out; documents of which no word is left go."""
    found = fmindex.contamination(packed(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    found = found.where((F.size("spans") == 0) | (hit < F.col("n_words")))
    return _measured(unpacked(fmindex.without_spans(found), docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, the number of them, and the text decoded from them again."""
    found = pieces.round_trip(docs, vocab.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: SQL has no SentencePiece model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
