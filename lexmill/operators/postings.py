"""Search over a written index of character 3-grams with their places.

The index is two tables. `postings` has a row for each gram, column and stretch of some SLICE characters of texts, with the
documents and blocks of BLOCK characters that hold the gram and its places in each as differences from the block's start, so
rows are short however long a text or a table is; they are written where they are made, so nothing but them goes to disk. Files are laid
out by the first character of the gram, so a term reads a few folders and, in them, the row groups of its grams. `documents` has the
length of each document and whatever queries filter and sort by. A change is a generation, a folder of its own in both
tables; of a document the highest generation counts. A change that is played again writes the same folder anew.

No query reads a text. A term of three characters or more is found where its grams stand at their distances; a shorter
one is the beginning of grams, as the last places of a text have grams of what is left.
"""

from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.plans.storage import discard, join_checked, materialize

N, BLOCK, SLICE, PARTS = 3, 4096, 1 << 20, 64
#: Bytes of texts that a task posts, more or less; it writes a file for each of PARTS.
TASK_BYTES = 64_000_000
#: Weights of a hit in title, number, issuer, text and keywords, and the constants of BM25.
WEIGHTS = {"title": 12.0, "number": 8.0, "issuer": 4.0, "text": 1.0, "keywords": 2.0}
K1, B = 1.2, 0.75
LIKE_COLUMNS = ("title", "text")
_POSTED = "gram string, field int, postings struct<docs:array<long>,blocks:array<long>,upto:array<int>,places:array<smallint>>"
_POSTINGS = f"{_POSTED}, generation int, part int"
SORTS = {
    "date_asc": lambda: [F.col("day").asc(), F.col("doc_id").asc()],
    "date_desc": lambda: [F.col("day").desc(), F.col("doc_id").desc()],
    "number_asc": lambda: [F.col("number_year").asc_nulls_last(), F.col("in_year").asc_nulls_last(), F.col("doc_id").asc()],
    "number_desc": lambda: [F.col("number_year").desc_nulls_last(), F.col("in_year").desc_nulls_last(), F.col("doc_id").desc()],
}


def _part(gram: Column) -> Column:
    return F.pmod(F.crc32(F.substring(gram, 1, 1).cast("binary")), F.lit(PARTS)).cast("int")


def _length(x: Column) -> Column:
    return F.length(F.coalesce(x, F.lit("")))


def _slices(batch):
    """A batch in parts of some SLICE characters, whole blocks each."""
    upto = np.cumsum(batch.column("n").to_numpy().astype(np.int64)) // SLICE
    cuts = [0, *(np.flatnonzero(upto[1:] != upto[:-1]) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _packed(batches):
    """The blocks of _gram_places as rows (gram, field, postings), one for each gram and field of a slice: `docs` and `blocks` that
    hold it, in order, `upto` the number of places up to each one's end, and all `places`."""
    for b in _gram_places(batches):
        if not b.num_rows:
            continue
        key = b.column("gram").dictionary_encode().indices.to_numpy().astype(np.int64) * len(WEIGHTS) + b.column("field").to_numpy()
        order = np.argsort(key, kind="stable")
        key, b = key[order], b.take(pa.array(order))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        each, at = np.r_[first, len(key)], b.column("places").offsets.to_numpy()
        upto = at[1:] - np.repeat(at[first], np.diff(each))
        lists = lambda values, ends=each: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        cells = [lists(b.column("doc_id")), lists(b.column("block")), lists(pa.array(upto, pa.int32())), lists(b.column("places").values, at[each])]
        rows = pa.array(first)
        yield pa.RecordBatch.from_arrays([b.column("gram").take(rows), b.column("field").take(rows), pa.StructArray.from_arrays(cells, ["docs", "blocks", "upto", "places"])], ["gram", "field", "postings"])


def _each_posting(*columns: str) -> list:
    """The columns, and `p`, struct<doc_id, block, places>, for each document and block of a row of postings."""
    of = lambda name: F.col(f"postings.{name}")
    before = lambda i: F.coalesce(F.get(of("upto"), i - 1), F.lit(0))
    one = lambda i: F.struct(F.get(of("docs"), i).alias("doc_id"), F.get(of("blocks"), i).alias("block"), F.slice(of("places"), before(i) + 1, F.get(of("upto"), i) - before(i)).alias("places"))
    return [*columns, F.explode(F.transform(F.sequence(F.lit(0), F.size(of("docs")) - 1), one)).alias("p")]


def _gram_places(batches):
    """Blocks (doc_id, field, block, x, n) as rows (gram, field, doc_id, block, places), for the first n places of x; the last
    grams of a text are what is left of it."""
    for batch in (part for b in batches for part in _slices(b)):
        texts = batch.column("x").to_pylist()
        chars = np.frombuffer("".join(t + "\0" * (N - 1) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + 1
        size, n = np.array([len(t) for t in texts], np.int64), batch.column("n").to_numpy().astype(np.int64)
        first = np.cumsum(size + N - 1) - size - N + 1
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        code = np.zeros(len(row), np.uint64)
        for k in range(N):  # 21 bits a character, one more than its number; 0 is the end of the text
            code = code << np.uint64(21) | np.where(at + k < size[row], chars[first[row] + at + k], 0)
        order = np.lexsort((code, row))  # stable, so places rise
        row, at, code = row[order], at[order], code[order]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
        distinct, which = np.unique(code[starts], return_inverse=True)
        grams = ["".join(chr((c >> 21 * k & 0x1FFFFF) - 1) for k in reversed(range(N)) if c >> 21 * k & 0x1FFFFF) for c in distinct.tolist()]
        places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(at + 1, pa.int16()))
        whose = pa.array(row[starts])
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()).take(pa.array(which)), *[batch.column(c).take(whose) for c in ("field", "doc_id", "block")], places], ["gram", "field", "doc_id", "block", "places"])


def append(docs: DataFrame, path: str, generation: int, deleted: DataFrame | None = None) -> None:
    """Write docs as a generation of the index at `path`, in place of what that generation held, with the doc_ids of
    `deleted` marked as gone; where docs has one of them too, it stays.

    docs has doc_id and the columns of WEIGHTS; all other columns go to the documents table, the same ones each time. Texts
    are case folded and taken whole. Nulls hold nothing; rows without a doc_id are left out; of rows with one doc_id the
    least counts, in the order of their texts.
    """
    order = [F.col(c).asc_nulls_first() for c in [*WEIGHTS, *sorted(set(docs.columns) - {"doc_id", *WEIGHTS})]]
    docs = docs.filter("doc_id is not null")
    least = lambda rows: rows.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter("_nth = 1").drop("_nth")
    # a task sorts what it writes, so its share is bounded, or tasks would spill as much as the tables are large
    length = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    one = least(docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, ceil(length / TASK_BYTES)), "doc_id"))
    # of the other columns only rows that share a doc_id are sorted, so that texts are not shuffled once more
    twice = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    alone = docs if twice.isEmpty() else join_checked(docs, twice, "doc_id", "left_anti").unionByName(least(join_checked(docs, twice, "doc_id", "left_semi")))
    size = sum((F.greatest(_length(F.col(c)) - (N - 1), F.lit(0)) for c in WEIGHTS), F.lit(0))
    kept = alone.select("doc_id", F.lit(False).alias("gone"), size.cast("long").alias("size"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    if deleted is not None:
        deleted = deleted.join(kept.select("doc_id"), "doc_id", "left_anti")
        kept = kept.unionByName(deleted.select("doc_id", F.lit(True).alias("gone")).distinct(), allowMissingColumns=True)
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("x")) for i, c in enumerate(WEIGHTS)]))
    cells = one.select("doc_id", fields.alias("f")).filter("f.x != ''")
    # blocks of a text are rows before its places are, so that no row holds all of a long text's grams
    blocks = cells.select("doc_id", "f.field", "f.x", F.explode(F.sequence(F.lit(0), F.floor((F.length("f.x") - 1) / BLOCK))).alias("block"))
    blocks = blocks.select("doc_id", "field", "block", F.substring("x", (F.col("block") * BLOCK + 1).cast("int"), F.lit(BLOCK + N - 1)).alias("x"), F.least(F.lit(BLOCK), F.length("x") - F.col("block") * BLOCK).cast("int").alias("n"))
    # a block is one row, so its places are put together where it is, and sorted and written there, without a shuffle
    rows = blocks.select("doc_id", "field", "block", "x", "n").mapInArrow(_packed, _POSTED)
    rows = rows.select(_part(F.col("gram")).alias("part"), "gram", "field", "postings")
    rows.sortWithinPartitions("part", "gram", "field").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{path}/postings/generation={generation}")
    kept.write.mode("overwrite").parquet(f"{path}/documents/generation={generation}")
    discard(twice)


@dataclass
class Search:
    """What is searched for: every term must hit one of the columns, not all the same one."""

    terms: list[str] = field(default_factory=list)
    where: Column | None = None
    sort: str = "relevance"
    limit: int = 10
    offset: int = 0
    everything: bool = False

    @property
    def mode(self) -> str:
        """phrases: all terms are long enough to be ranked; like: a short one is among them; filter: there are none."""
        return "filter" if not self.words else "phrases" if all(len(t) >= N for t in self.words) else "like"

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(t.lower() for t in self.terms if t))


def live_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the index as they are now: of each the highest generation, unless that is its end."""
    docs = spark.read.parquet(f"{path}/documents")
    now = docs.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), "generation").alias("d"))
    return now.select("doc_id", "d.*").filter("not gone").drop("gone")


def occurrences(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(term, doc_id, generation, field, n): how often each word stands in each column, overlapping ones counted each."""
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    wanted = [(i, w[o : o + N], o, w) for i, w in enumerate(words) if len(w) >= N for o in sorted({*range(0, len(w) - N + 1, N), len(w) - N})]
    found = []
    if wanted:
        grams = spark.createDataFrame([(i, g, o) for i, g, o, _ in wanted], "term int, gram string, shift int")  # as many rows as the query has grams
        need = spark.createDataFrame([(i, sum(x[0] == i for x in wanted)) for i in sorted({x[0] for x in wanted})], "term int, need int")
        folders = grams.select(_part(F.col("gram")).alias("part")).distinct()
        parts = sorted(r["part"] for r in folders.collect())
        rows = postings.filter(F.col("part").isin(parts) & F.col("gram").isin(sorted({x[1] for x in wanted}))).join(F.broadcast(grams), "gram")
        starts = rows.select(*_each_posting("term", "generation", "field", "shift")).select("term", "p.doc_id", "generation", "field", F.explode("p.places").alias("at"), "p.block", "shift").withColumn("start", F.col("block") * BLOCK + F.col("at") - F.col("shift"))
        whole = starts.groupBy("term", "doc_id", "generation", "field", "start").agg(F.count("*").alias("got")).join(F.broadcast(need), "term").filter("got = need")
        found.append(whole.groupBy("term", "doc_id", "generation", "field").agg(F.count("*").alias("n")))
    for i, w in enumerate(words):
        if len(w) < N:
            part = spark.range(1).select(_part(F.lit(w))).first()[0]
            rows = postings.filter((F.col("part") == part) & F.startswith("gram", F.lit(w)))
            rows = rows.select(*_each_posting("generation", "field")).select("p.doc_id", "generation", "field", F.size("p.places").alias("n"))
            found.append(rows.groupBy("doc_id", "generation", "field").agg(F.sum("n").alias("n")).select(F.lit(i).alias("term"), "doc_id", "generation", "field", "n"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def search(spark: SparkSession, path: str, q: Search) -> DataFrame:
    """(place, doc_id, title, day, score, total, has_more, mode, hint): a page of hits, from the index alone.

    Unless `everything` is set only the official layer is searched (a null counts as official). By relevance, phrases are
    ranked by BM25 over the weighted columns, and searches with a short term, which look at title and text only, by
    whether the title has the first term; then come substantive documents, later days and greater ids. `limit` is
    clamped to 1..50, `offset` to 0 or more. total and has_more come from the same rows as the page. Where nothing is
    hit there is one row, without a doc_id, whose hint is `no_hits`; on a page that isn't the last it is `more`.
    """
    limit, offset, words = min(50, max(1, q.limit)), max(0, q.offset), q.words
    live = live_documents(spark, path)
    hits = live if q.everything else live.filter(F.coalesce("is_official", F.lit(1)) == 1)
    if q.where is not None:
        hits = hits.filter(q.where)
    score = F.lit(0.0)
    if words:
        names = list(WEIGHTS)
        found = occurrences(spark, path, words)
        if q.mode == "like":
            found = found.filter(F.col("field").isin([names.index(c) for c in LIKE_COLUMNS]))
        weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS.values()]), F.col("field") + 1)
        found = found.join(live.select("doc_id", "generation", "size"), ["doc_id", "generation"])
        found = found.groupBy("doc_id", "size", "term").agg(F.sum(F.col("n") * weight).alias("tf"), F.max((F.col("field") == 0).cast("int")).alias("in_title"))
        if q.mode == "phrases":
            totals = live.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
            df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row a term
            idf = F.greatest(F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
            part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
            found = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals)).withColumn("part", part)  # one row of totals
        else:
            found = found.withColumn("part", F.when(F.col("term") == 0, F.col("in_title")).otherwise(0).cast("double"))
        found = found.groupBy("doc_id").agg(F.count("*").alias("held"), F.round(F.sum("part"), 6).alias("score")).filter(F.col("held") == len(words)).drop("held")
        hits, score = hits.join(found, "doc_id"), F.col("score")
    hits = hits.select("doc_id", "title", "day", "number_year", "in_year", "tier", score.alias("score"))
    order = SORTS[q.sort]() if q.sort in SORTS else [F.col("score").desc(), F.col("tier").asc(), F.col("day").desc(), F.col("doc_id").desc()]
    page = hits.orderBy(*order).offset(offset).limit(limit)  # at most 50 rows, so the window below has one task's worth
    page = page.withColumn("place", F.row_number().over(Window.orderBy(*order)) + offset).select("place", "doc_id", "title", "day", "score")
    totals = hits.agg(F.count("*").alias("total"))
    out = totals.join(page, F.lit(True), "left")  # one row of totals
    more = (F.col("place").isNotNull()) & (F.col("total") > offset + limit)
    hint = F.when(F.col("place").isNull(), "no_hits").when(more, "more")
    return out.select("place", "doc_id", "title", "day", "score", "total", more.alias("has_more"), F.lit(q.mode).alias("mode"), hint.alias("hint"))
