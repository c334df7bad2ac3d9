"""Quality rules: figures of each text, and how often its lines occur across the documents of a host.

Only DataFrame functions. The figures of a text are worked out within its row. For the cross-document rule the
lines of each text are normalised and hashed, the distinct documents of a host that hold a line are counted, and lines
above the limits count as removed; a document that has lost most of its words is rejected as depleted. Lines of every
length are looked at. The shuffles hold hashes and counts, never texts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.storage import join_checked, materialize

SPACE = r"[\x20\x09-\x0D]"
#: A line is boilerplate if more than this share of a host's distinct documents hold it, and at least so many of them.
MAX_SHARE, MIN_DOCUMENTS = 0.01, 20
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.2


def let(value: Column, use) -> Column:
    """use(value) with value worked out once a row; a lambda's variable is not copied into the expression."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _repeat_words(words: Column, window: int) -> Column:
    """Words covered by windows that occur twice or more in the list."""

    def hashes(w: Column) -> Column:
        return F.when(F.size(w) < window, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(window)])))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        twice = let(
            pairs,
            lambda p: F.filter(
                F.transform(p, lambda x, i: F.when((F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["at"])),
                lambda at: at.isNotNull(),
            ),
        )
        # places in order: each window adds its words up to the next one's start
        return let(F.array_sort(twice), lambda s: F.aggregate(F.transform(s, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - at, F.lit(window)))), F.lit(0).cast("long"), lambda n, x: n + x))

    return let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def _row_hash() -> list[Column]:
    """Two 64-bit hashes of a row's doc_id, source and text, on which its verdict depends, and on nothing else."""
    parts = [c for name, kind in (("doc_id", "long"), ("source", "string"), ("text", "string")) for c in (F.col(name).isNull(), F.col(name).cast(kind))]
    return [F.xxhash64(*parts).alias("_row1"), F.xxhash64(F.lit(1), *parts).alias("_row2")]


def figures(docs: DataFrame, window: int = 5) -> DataFrame:
    """docs' doc_id and source with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for the
    cross-document rule, the row's hash (two numbers) and its lines with their words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), *_row_hash())
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    normal = lambda x: F.array_join(_words(F.lower(x)), " ")
    return bare.select(
        "doc_id",
        "source",
        "_row1",
        "_row2",
        let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, window).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.transform(x, lambda y: let(normal(y), lambda z: F.struct(F.xxhash64(z).alias("line"), (F.length(z) - F.length(F.translate(z, " ", "")) + 1).cast("long").alias("words")))).alias("lines"),
            ),
        ).alias("l"),
    ).select("doc_id", "source", "_row1", "_row2", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.lines")


def _judged(docs: DataFrame) -> DataFrame:
    """figures() without lines, and base_failed, removed_words, removed_lines (their hashes, null for none) and kept."""
    rows = materialize(figures(docs).withColumn("row", F.monotonically_increasing_id()))
    host = [F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNull().alias("no_host")]
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))  # a row without an id is a document
    held = rows.select(*host, document.alias("document"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    many = held.distinct().groupBy("host", "no_host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCUMENTS)
    hosts = rows.select(*host, document.alias("document")).distinct().groupBy("host", "no_host").agg(F.count("*").alias("documents")).filter(F.col("documents") >= MIN_DOCUMENTS)
    often = join_checked(many, hosts, ["host", "no_host"]).filter(F.col("n") > MAX_SHARE * F.col("documents")).select("host", "no_host", "line")
    mine = rows.select("row", *host, F.explode("lines").alias("l")).select("row", "host", "no_host", "l.line", "l.words")
    lost = join_checked(mine, often, ["host", "no_host", "line"]).groupBy("row").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("removed_lines"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    kept = ~base & (F.col("n_words") - removed >= LEFT_SHARE * F.col("n_words"))
    return rows.drop("lines", "source").join(lost, "row", "left").drop("row").withColumn("base_failed", base).withColumn("removed_words", removed).withColumn("kept", kept)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept).

    base_failed: under 10 words, or over 20 % of the words in repeated five-word windows. kept: not base_failed and
    not depleted by the removal of lines that too many documents of the host share. Null texts have no words and fail;
    a null source is a host of its own; rows that repeat a doc_id are one document in the counts and are judged each by
    its own text; a row without a doc_id is a document of its own; very long texts are judged whole; an empty table
    gives an empty table; other columns are not read.
    """
    return _judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def keep_by_rules(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps, each by its own verdict (equal rows have the same), with
    text less the lines that too many documents of the host share.

    Nulls, ties, repeated rows, odd texts and empty tables are as in quality_rules; a text without such lines stays as it
    is, and columns of docs may have any names.
    """
    changed = _judged(docs).filter(~F.col("kept") | F.col("removed_lines").isNotNull()).select("_row1", "_row2", "kept", "removed_lines").dropDuplicates(["_row1", "_row2"])
    names = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = docs.select("*", *_row_hash()).toDF(*names, "_row1", "_row2")
    text = F.col(names[docs.columns.index("text")])
    left = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains("removed_lines", F.xxhash64(F.array_join(_words(F.lower(x)), " "))))
    found = join_checked(keyed, changed, ["_row1", "_row2"], "left").filter(F.coalesce("kept", F.lit(True)))
    return found.select(*[(F.when(F.col("removed_lines").isNull(), text).otherwise(F.array_join(left, "\n")) if c == "text" else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])
