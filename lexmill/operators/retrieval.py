"""Retrieval for several facts at once, each with queries of its own, the most telling first."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How much a hit in the title weighs (more than a scan is long, so it comes first), the total of hits that
# halves a query's weight, the region that goes before others, and what is in force before what is not.
TITLE_WEIGHT, COMMON, EVERYWHERE = 20.0, 200.0, "全国"
STATUS_ORDER = {"现行有效": 0, "尚未生效": 1, "部分失效": 2, "已废止": 3}


def ranked_hits(docs: DataFrame, queries: DataFrame, scan: int = 50) -> DataFrame:
    """(fact, place, query, total, rank, doc_id, title, number, region, status): for each query the first `scan` documents,
    from rank 0, and how many there are. queries (fact, place, query) are as many as people ask, so they are broadcast.

    A document is hit where its title or text holds the query, case folded; more often is better, in the title twelve
    times so; then comes the smaller doc_id. Null texts hold nothing, an empty query is passed over.
    """
    # a row of docs is read once for all queries, and only the ranks' columns go on
    asked = F.broadcast(queries.filter("query != ''").withColumn("low", F.lower("query")))
    rows = docs.select("doc_id", "title", "number", "region", "status", F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.coalesce("text", F.lit(""))).alias("x"))
    hits = rows.join(asked, F.contains("x", F.col("low")) | F.contains("t", F.col("low")))
    times = lambda c: (F.length(c) - F.length(F.replace(c, F.col("low"), F.lit("")))) / F.length("low")
    hits = hits.select("fact", "place", "query", "doc_id", "title", "number", "region", "status", (12 * times("t") + times("x")).alias("weight"))
    totals = hits.groupBy("fact", "place").agg(F.count("*").alias("total"))
    order = Window.partitionBy("fact", "place").orderBy(F.col("weight").desc(), "doc_id")
    top = hits.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < scan).drop("weight")
    return top.join(F.broadcast(totals), ["fact", "place"])  # a row a query


def gather(hits: DataFrame, most: int = 8) -> DataFrame:
    """(fact, nth, doc_id, key, score): the first `most` documents of each fact.

    A hit counts 1 / (its query's place + 1), less the more hits the query has, twenty times if the title holds the query,
    and divided by its rank + 1. Hits with one number are one document: of them the first for the whole country, else
    the first; their scores add up. Ties go to what is in force, then to the earlier hit.
    """
    key = F.coalesce(F.nullif("number", F.lit("")), F.col("doc_id").cast("string"))
    weight = (1 / (F.col("place") + 1)) / (1 + F.col("total") / COMMON) * F.when(F.contains(F.coalesce("title", F.lit("")), F.col("query")), TITLE_WEIGHT).otherwise(1.0) / (F.col("rank") + 1)
    first = F.struct((F.coalesce("region", F.lit("")) != EVERYWHERE).alias("local"), "place", "rank")
    order = F.lit(4)
    for status, n in STATUS_ORDER.items():
        order = F.when(F.col("kept.status") == status, n).otherwise(order)
    docs = hits.select("*", key.alias("key"), weight.alias("weight")).groupBy("fact", "key").agg(
        F.round(F.sum("weight"), 6).alias("score"), F.min_by(F.struct("doc_id", "status"), first).alias("kept"), F.min(F.struct("place", "rank")).alias("seen")
    )
    by = Window.partitionBy("fact").orderBy(F.col("score").desc(), order, "seen")
    return docs.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= most).select("fact", "nth", "kept.doc_id", "key", "score")
