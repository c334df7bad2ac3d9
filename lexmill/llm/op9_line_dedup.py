"""Line deduplication by overlapping windows of three lines.

Only DataFrame functions. Each text is cut at line ends; lines with words are normalised and hashed, and every three
consecutive ones make a window. Windows are compared over the whole table: the first occurrence, by doc_id and place,
stays; later ones are removed, overlapping windows merging into runs of covered lines. A repeated passage of over
PASSAGE_WORDS words may stand on fewer than three lines, so one or two consecutive lines that hold so many words are a
window too. A repeated passage that lies inside lines which differ stays.

What is compared are compact rows (two hashes of 64 bits, document, place). The first occurrence of each window is a
minimum that is aggregated before the shuffle, so a window which a third of all texts hold is one row a task; in the
join back to the occurrences adaptive execution splits a hot hash. Texts are written once with a number for each row,
and shuffled once, when covered places are taken to them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.op6_quality_rules import SPACE, let
from lexmill.plans.storage import materialize

WINDOW, PASSAGE_WORDS = 3, 50
_SPANS = "array<struct<first:int,last:int,h:bigint,g:bigint>>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column) -> Column:
    """(place of the first line, place of the last, two hashes) of each window."""

    def one(line: Column, at: Column) -> Column:
        return let(
            F.trim(F.regexp_replace(F.lower(line), SPACE + "+", " ")),
            lambda z: F.struct(
                at.alias("at"), F.when(z == "", F.lit(0)).otherwise(F.length(z) - F.length(F.replace(z, F.lit(" "), F.lit(""))) + 1).alias("words"), F.xxhash64(z).alias("h"), F.xxhash64(F.lit(1), z).alias("g")
            ),
        )

    def spans(s: Column) -> Column:
        def runs(n: int, least: int) -> Column:
            every = F.when(F.size(s) >= n, F.sequence(F.lit(0), F.size(s) - n)).otherwise(F.array().cast("array<int>"))
            part = lambda i, field: [F.get(s, i + k)[field] for k in range(n)]
            if least:
                every = F.filter(every, lambda i: sum(part(i, "words"), F.lit(0)) > least)
            return F.transform(every, lambda i: F.struct(F.get(s, i)["at"].alias("first"), F.get(s, i + n - 1)["at"].alias("last"), F.xxhash64(*part(i, "h")).alias("h"), F.xxhash64(*part(i, "g")).alias("g"))).cast(_SPANS)

        return F.concat(runs(WINDOW, 0), *[runs(n, PASSAGE_WORDS) for n in range(1, WINDOW)])

    return let(F.filter(F.transform(lines, one), lambda x: x["words"] > 0), spans)


def _without(lines: Column, covered: Column) -> Column:
    """The lines whose places are not in the ordered list `covered`: slices between covered places."""

    def rest(u: Column) -> Column:
        between = F.arrays_zip(F.concat(F.array(F.lit(-1)), covered).alias("a"), F.concat(covered, F.array(F.size(u))).alias("b"))
        return F.array_join(F.flatten(F.transform(between, lambda e: F.slice(u, e["a"] + 2, e["b"] - e["a"] - 1))), "\n")

    return let(lines, rest)


def covered_lines(docs: DataFrame) -> DataFrame:
    """(row, covered): for each row that holds later occurrences, the places of the lines to remove, in order.

    docs has doc_id, text and row, a number that stands for the row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = (1 << 63) - 1
    windows = materialize(
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc"), "row", F.explode(_windows(_lines(text))).alias("w")).select("w.h", "w.g", "doc", "row", "w.first", "w.last")
    )
    place = F.struct("doc", "row", "first", "last")
    repeated = materialize(windows.groupBy("h", "g").agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").select("h", "g", "kept"))
    later = windows.join(repeated, ["h", "g"]).filter(place > F.col("kept"))
    # where a window overlaps the one that stays, the lines of that one stay
    first = F.when(F.col("row") == F.col("kept.row"), F.greatest(F.col("first"), F.col("kept.last") + 1)).otherwise(F.col("first"))
    runs = later.select("row", first.alias("first"), "last").filter("first <= last").groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return runs.select("row", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))).alias("covered"))


def _deduped(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text less its repeated lines, and _n_lines and _n_removed."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    covered = materialize(covered_lines(rows.select("doc_id", "text", F.col("_row").alias("row"))))
    lines = _lines(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = rows.join(covered.select(F.col("row").alias("_row"), F.col("covered").alias("_covered")).hint("shuffle_hash"), "_row", "left")
    return out.select(
        *[F.when(F.col("_covered").isNull(), F.col("text").cast("string")).otherwise(_without(lines, F.col("_covered"))).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("_n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text less its repeated lines, and n_lines and n_removed (long).

    Null and empty texts stay as they are; very long texts are worked whole. Of rows that repeat, or share a doc_id, the
    first as read is the earlier occurrence. Rows without a doc_id come last in the order of occurrences. An empty
    table gives an empty table; columns of docs named n_lines or n_removed are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _deduped(docs).select(*kept, F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs less repeated lines, without the rows of which no word is left; the columns are those of docs."""
    found = _deduped(docs)
    empty = (F.col("_n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.filter(~F.coalesce(empty, F.lit(False))).select(*docs.columns)
