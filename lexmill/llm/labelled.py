"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.storage import discard, join_checked, materialize

#: Characters of sampled texts that reach the driver at most (the sample ends where they are used up).
SAMPLE_CHARS = 48_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column, chars: int = SAMPLE_CHARS) -> tuple[list[tuple[str, int]], float]:
    """At most `rows` (text, label) pairs, shared equally by the two classes as far as they go, and the shift.

    The shift is what the log-odds of a model of the sample lack where a class was cut: the difference of the
    classes' logarithms of labels there are to labels taken. With it scores mean the same at every size of table.
    keep is a predicate Column over doc_id that says which labels may be learnt from. Rows are taken in the order
    of a hash of doc_id, so the sample is the same in every run. Texts are taken whole, whatever their length; a
    class's part of the sample ends before its texts exceed half of `chars`. Of rows that repeat a doc_id the greatest
    label and the least text count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & keep)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    there = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    half = [known.filter(F.col("label") == k).orderBy("order", "doc_id").limit(rows // 2) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    found = materialize(join_checked(texts, half[0].unionByName(half[1]), "doc_id").groupBy("doc_id", "label", "order").agg(F.min("text").alias("text")))
    size = found.select("label", "order", "doc_id", F.length("text").alias("n")).collect()  # at most `rows` rows of numbers
    last, taken = {}, {}
    for k in (0, 1):
        mine = sorted((r["order"], r["doc_id"], r["n"]) for r in size if r["label"] == k)
        whole = [m for m, total in zip(mine, accumulate(m[2] for m in mine), strict=True) if total <= chars // 2]
        last[k], taken[k] = (whole[-1][0] if whole else None), len(whole) or 1
    within = [(F.col("label") == k) & (F.col("order") <= at) for k, at in last.items() if at is not None]
    rows_in = found.filter(within[0] if len(within) == 1 else within[0] | within[1]).collect() if within else []
    discard(found)
    cut = {k: len([r for r in size if r["label"] == k]) for k in (0, 1)}
    logs = [math.log(max(1, there.get(k, 0) / max(1, rows // 2))) + math.log(max(1, cut[k] / taken[k])) for k in (0, 1)]
    return [(r["text"], r["label"]) for r in sorted(rows_in, key=lambda r: r["doc_id"])], logs[1] - logs[0]


def remainder(column: str, of: int) -> Column:
    """crc32 of the column's text, modulo `of`; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of))
