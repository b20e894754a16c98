"""Queries of this package and their check SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import (
    cells, fillmiddle, fmindex, jaccard, language, lines, packing, perspectives, pieces, pseudonyms, repair, sharding, tokenfile,
    vocab,
)
from barline.llm.checks import CHECKS
from barline.session import work_folder

#: For the registered query only; a real key is given by the caller and kept secret.
SAMPLE_KEY = "sample"

__all__ = ["CHECKS", "QUERIES"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def op2_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, folder, "documents").select("doc_id", "text"), SAMPLE_KEY)


def op3_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"))


def op4_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    views = perspectives.rotate(table(spark, folder, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return views.withColumn("mask", mask)


def op5_embedding_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells.near_duplicates(table(spark, folder, "embeddings"))


def op6_fm_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = fmindex.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), keep_text=False)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), vocab.path("piece_bpe_32k.model"), keep=["doc_id"])


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


def op9_rank_order_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.predict(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "tokens")
    tokenfile.write_tokens(table(spark, folder, "documents"), out, vocab.path("byte_bpe_50k.json"))
    return tokenfile.index(spark, out)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.report(repair.repair(repair.damage(table(spark, folder, "conversations"))))


def op12_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.piece_digests(table(spark, folder, "documents"), vocab.path("byte_bpe_50k.json"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fillmiddle.transform(table(spark, folder, "documents"), keep=["doc_id"])
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fillmiddle.restored(), 256).alias("restored_sha256"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_feistel_pseudonyms": op2_feistel_pseudonyms,
    "op3_jump_sharding": op3_jump_sharding,
    "op4_perspective_rotation": op4_perspective_rotation,
    "op5_embedding_cells": op5_embedding_cells,
    "op6_fm_decontamination": op6_fm_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_line_dedup": op8_line_dedup,
    "op9_rank_order_language": op9_rank_order_language,
    "op10_token_files": op10_token_files,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sequence_packing": op12_sequence_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}
