"""The operators of this subpackage as queries over the tables, with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import op1_html, op2_simhash, op3_quality, op4_embedding, op5_packing, op6_quality_rules, op7_chat, op8_toxicity, op9_line_dedup, op10_bpe, op11_alignment, op12_counts, op13_merkle
from lexmill.plans.storage import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_html.extract_main_text(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose turns hold control strings."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return op7_chat.read_windows(op7_chat.format_windows(rows))


def op8_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_alignment.alignment_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_simhash_near_dedup, op3_quality_classifier, op4_embedding_near_dedup, op5_best_fit_packing, op6_line_frequency_rules, op7_chat_formatting, op8_toxicity_scores, op9_line_window_dedup, op10_bpe_round_trip, op11_tokenizer_alignment, op12_token_counts, op13_merkle_manifest)}
