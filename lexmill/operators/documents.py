"""Search, ranking, audits and maintenance of document collections."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def search(docs: DataFrame, terms: list[str], limit: int = 10, offset: int = 0, where: Column | None = None) -> DataFrame:
    """Hits that contain every term: title hits first, then longer texts, then doc_id; limit is clamped to 1..50."""
    title = T.title_of(F.col("text"))
    hits = docs.filter(T.all_terms(F.col("text"), terms) & (F.lit(True) if where is None else where))
    first = T.all_terms(title, terms[:1]) if terms else F.lit(False)
    order = [F.col("title_hit").desc(), F.col("n_chars").desc_nulls_last(), "doc_id"]
    top = hits.select("doc_id", "lang", first.cast("int").alias("title_hit"), "n_chars", "text").orderBy(*order).offset(max(0, offset)).limit(min(50, max(1, limit)))
    # snippets are cut from the rows of the page alone
    return top.select("doc_id", "lang", "title_hit", "n_chars", (T.snippet(F.col("text"), terms) if terms else F.substring("text", 1, 260)).alias("snippet"))


def bm25(docs: DataFrame, terms: list[str], weights=(("title", 12.0), ("text", 1.0)), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents that hold any term; lengths in characters, statistics in one aggregate pass."""
    base = docs.select("doc_id", T.title_of(F.col("text")).alias("title"), "text")
    tf = [sum((T.occurrences(F.col(c), t) * w for c, w in weights), F.lit(0.0)) for t in terms]
    size = sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c, _ in weights), F.lit(0))
    scored = base.select("doc_id", size.alias("size"), *[x.alias(f"tf{i}") for i, x in enumerate(tf)])
    stats = scored.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = scored.crossJoin(F.broadcast(stats))  # one row of totals
    parts = [
        F.greatest(F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
        for i in range(len(terms))
    ]
    return joined.select("doc_id", sum(parts, F.lit(0.0)).alias("score")).filter("score > 0")


def fuse(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of tables (key, rank): sum of 1 / (k + rank)."""
    parts = [r.select(F.col(key), (1 / (F.lit(k) + F.col("rank"))).alias("part")) for r in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.sum("part").alias("score"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Merged rows with `change` new, updated, unchanged or kept; nulls of the new rows overwrite nothing."""
    both = old.select(key, *columns, F.lit(True).alias("here")).alias("o").join(new.select(key, *columns, F.lit(True).alias("here")).alias("n"), key, "full_outer")
    merged = {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in columns}
    is_new, is_old = F.col("o.here").isNull(), F.col("n.here").isNull()
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~merged[c].eqNullSafe(F.col(f"o.{c}"))
    change = F.when(is_new, "new").when(is_old, "kept").when(differs, "updated").otherwise("unchanged")
    return both.select(key, *[m.alias(c) for c, m in merged.items()], change.alias("change"))


def audit_pairs(turns: DataFrame) -> DataFrame:
    """Questions with the answer that follows: length ratio, numbers lost, truncated tail, and the codes found."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("answer", F.lead("text").over(by)).withColumn("next_role", F.lead("role").over(by)).filter("role = 'user' and next_role = 'assistant'")
    n, m = F.length("text"), F.length("answer")
    lost = F.size(F.array_except(T.numbers(F.col("text")), T.numbers(F.col("answer"))))
    return pairs.select("conv_id", "turn", n.alias("n_source"), m.alias("n_target"), (m < 0.4 * n).alias("short"), (~F.rtrim("answer").rlike(r"[.!?…]$")).alias("cut"), lost.cast("long").alias("numbers_lost"))


def ngram_candidates(left: DataFrame, right: DataFrame, n: int = 5, common: int | None = None) -> DataFrame:
    """Distinct (left_id, right_id) that share an n-gram of characters; both have (id, title).

    Blocking for fuzzy matching. With `common`, n-grams which more rights hold are not joined on; the default drops
    none, and adaptive execution splits the hot ones.
    """
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))))
    a, b = left.select(F.col("id").alias("left_id"), grams(F.col("title")).alias("gram")), right.select(F.col("id").alias("right_id"), grams(F.col("title")).alias("gram"))
    if common is not None:
        b = b.join(b.groupBy("gram").count().filter(F.col("count") <= common).select("gram"), "gram")
    return a.join(b, "gram").select("left_id", "right_id").distinct()


def longer_titles(titles: DataFrame, least: int) -> DataFrame:
    """titles (title, ...) with n_longer: how many rows have a longer title that begins with this one. Only titles of `least`
    characters or more count, and only rows with a longer one are returned.

    Equal titles are one row with a number. Each distinct title is posted under its own beginnings, so the work grows with
    their characters and no pair is made.
    """
    titles = titles.filter(F.length("title") >= least)
    distinct = titles.groupBy("title").agg(F.count("*").alias("n"))
    starts = F.transform(F.sequence(F.lit(least), F.length("title") - 1), lambda i: F.substring("title", F.lit(1), i))
    posts = distinct.filter(F.length("title") > least).select(F.explode(starts).alias("title"), "n")
    longer = posts.groupBy("title").agg(F.sum("n").alias("n_longer"))
    return titles.join(longer, "title")


def merge_spans(spans: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Spans of each key that touch or overlap, merged, with the number of spans in each."""
    order = Window.partitionBy(*keys).orderBy(first, last)
    before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before >= F.col(first), 0).otherwise(1)
    rows = spans.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(first).alias(first), F.max(last).alias(last), F.count("*").alias("n")).drop("_island")
