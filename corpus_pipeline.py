"""The corpus pipeline: quality classifier, quality rules, line dedup, SimHash near-dedup and packing, in this order.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again as the next one's docs. All stages
but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import op2_simhash, op3_quality, op5_packing, op6_quality_rules, op9_line_dedup
from lexmill.plans.storage import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; null and empty texts are scored like any other, rows that repeat or
    share a doc_id each by their own text. Without labels of both classes the scores, and so the choice,
    mean nothing."""
    return op3_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject, and from the others the lines that too many documents of a host share. Null
    texts fail; equal rows have one verdict; a null source is a host of its own."""
    return op6_quality_rules.keep_by_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated lines, and documents of which nothing is left; null texts stay null, of rows that
    repeat the first as read is the earlier one, rows without a doc_id come last."""
    return op9_line_dedup.drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the smallest doc_id, null last, then the first as read. Null
    and empty texts are alike; a row that shares its doc_id goes or stays by its own text."""
    return op2_simhash.drop_near_duplicates(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' pieces in sequences; a null text is empty and takes one token, repeated rows are packed each."""
    return op5_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=500_000)  # beside heaps that earlier stages have grown


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("best_fit_packing", best_fit_packing)]

#: The classifier and SimHash are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. An empty table gives an empty result; other columns pass through all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
