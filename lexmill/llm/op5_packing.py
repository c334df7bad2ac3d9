"""Best-fit packing of tokenised documents into sequences of fixed length.

Bulk-synchronous best fit. Pieces and gaps (open sequences with equal room left) are kept as tables of runs: pieces of
one length with consecutive ranks, gaps of one room with consecutive numbers. They are dealt to parts, each of a bounded
share of the corpus, and sorted by size within a part. A round is one Spark job: in every part a sweep from the largest
size to the smallest matches each run of pieces with its successor, the smallest gap that is not shorter; where more
pieces than gaps meet, the lower ranks get them and the others go on to the next successor. What is left of the gaps
is a new table of runs, and the next round begins. Long pieces come first: a round admits the pieces over a bound, which
goes down once they are placed. Then parts are merged, few at a time, and what no part had room for is matched with
the gaps of the others, until one part is left, which opens the last sequences.

Pieces of full length need no match. Ranks are taken in salted parts of each length, whose number grows with the corpus,
so no length is one task's work; the runs, the gaps and the plan of the matches are bounded by lengths and parts.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.batches import slices
from lexmill.llm.bpe import WordCodec, codec
from lexmill.plans.storage import join_checked, materialize

#: Words a worker keeps the ids of at most; fewer take less memory and more time, and change no result.
KEPT_WORDS = 1_200_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False, keep: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and end_id, cut if longer than length."""

    def run(batches):
        c = codec(WordCodec, tokenizer, keep=keep)
        for b in slices(batches):
            out = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), c.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += int(end_id).to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols[:n], kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


#: Pieces of a part at most, about; parts that are merged into one; bounds of the pieces that rounds admit, as shares of a sequence.
PART_PIECES, MERGED = 500_000, 16
ADMITTED = (2, 3, 4, 8, 16, 32)
_TABLE = "kind string, home int, part long, size int, first long, n long, slot long, per int, at int"


def sweep(pieces: list[tuple], gaps: list[tuple], room: int) -> tuple[list, list, list]:
    """One sweep of a part: pieces (home, size, first, n) and gaps (room left, first sequence, n), in any order.

    Returns the pieces left, the gaps left and the matches (home, size, first rank, pieces, first sequence, pieces a
    sequence, offset). A gap is filled with as many pieces of the run as it holds; what remains of it waits for the
    next round.
    """
    left, after, matches = [], [], []
    gaps = sorted(gaps)  # the smallest gap that is not shorter than the pieces is the last one of `open`
    open_, at = [], len(gaps) - 1
    for home, size, first, n in sorted(pieces, key=lambda p: (-p[1], p[0], p[2])):
        while at >= 0 and gaps[at][0] >= size:
            open_.append(gaps[at])
            at -= 1
        while n and open_:
            gap, slot, many = open_.pop()
            per = gap // size
            whole = min(many, n // per)
            for take, each in ((whole, per), (int(whole < many and 0 < n - whole * per < per), n - whole * per)):
                if take:
                    matches.append((home, size, first, take * each, slot, each, room - gap))
                    if gap > each * size:
                        after.append((gap - each * size, slot, take))
                    first, n, slot, many = first + take * each, n - take * each, slot + take, many - take
            if many:
                open_.append((gap, slot, many))
        if n:
            left.append((home, size, first, n))
    return left, after + open_ + gaps[: at + 1], matches


def _round(room: int, over: int):
    """Sweeps of the parts in a task, whose rows come sorted by part; pieces of up to `over` wait.

    Every part goes on until the admitted pieces are placed or find no gap.
    """

    def settle(part: int, rows: list[tuple]):
        wait = [(h, s, f, n) for kind, h, s, f, n in rows if kind == "piece" and s <= over]
        pieces = [(h, s, f, n) for kind, h, s, f, n in rows if kind == "piece" and s > over]
        gaps = [(s, f, n) for kind, _, s, f, n in rows if kind == "gap"]
        done: list = []
        while pieces:
            pieces, gaps, found = sweep(pieces, gaps, room)
            done += found
            if not found:
                break
        out = [("piece", h, part, s, f, n, None, None, None) for h, s, f, n in wait + pieces]
        out += [("gap", 0, part, s, f, n, None, None, None) for s, f, n in gaps]
        return out + [("match", h, part, s, f, n, slot, per, at) for h, s, f, n, slot, per, at in done]

    def batch(out):
        cols = list(zip(*out, strict=True)) or [[]] * 9
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _TABLE.split(", ")])

    def run(batches):
        part, rows = None, []
        for b in batches:
            for p, *row in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "home", "size", "first", "n")), strict=True):
                if p != part:
                    if rows:
                        yield batch(settle(part, rows))
                    part, rows = p, []
                rows.append(tuple(row))
        if rows:
            yield batch(settle(part, rows))

    return run


def match(runs: DataFrame, room: int, parts: int) -> DataFrame:
    """(home, size, first, n, slot, per, at) for runs(home, size, first, n) with home from 0 to parts - 1: n pieces
    from rank `first` on, in sequences from number `slot` on, `per` pieces each, at offset `at`.

    Two figures a round reach the driver: the tokens of pieces that wait, and whether any do.
    """
    spark = runs.sparkSession
    table = runs.select(F.lit("piece").alias("kind"), "home", F.col("home").cast("long").alias("part"), "size", "first", "n", *[F.lit(None).cast(t).alias(c) for c, t in (("slot", "long"), ("per", "int"), ("at", "int"))])
    tokens = F.sum(F.col("size").cast("long") * F.col("n"))
    opened = table.groupBy("part").agg(tokens.alias("tokens"))
    down = F.floor if parts > 1 else F.ceil  # a part does not open what others may have room for
    base = F.col("part") * (1 << 40)
    gaps = opened.select(F.lit("gap").alias("kind"), F.lit(0).alias("home"), "part", F.lit(room).alias("size"), base.alias("first"), down(F.col("tokens") / room).cast("long").alias("n"))
    now = materialize(table.unionByName(gaps.filter("n > 0"), allowMissingColumns=True))
    admitted, matches, fresh = [*(room // k for k in ADMITTED), 0], [], parts << 40
    while True:
        over = admitted.pop(0) if admitted else 0
        dealt = now.filter("kind != 'match'").repartition(parts, "part").sortWithinPartitions("part", F.col("size").desc(), "kind")
        now = materialize(dealt.mapInArrow(_round(room, over), _TABLE))
        matches.append(now)
        if admitted:
            continue
        wait = now.filter("kind = 'piece'").agg(tokens.alias("t")).first()["t"]
        if not wait:
            break
        if parts > 1:
            parts = -(-parts // MERGED)
            now = now.withColumn("part", F.floor(F.col("part") / MERGED).cast("long"))
        if parts == 1:
            more = spark.createDataFrame([("gap", 0, 0, room, fresh, -(-wait // room), None, None, None)], _TABLE)
            fresh += -(-wait // room)
            now = now.unionByName(more)
    found = matches[0].filter("kind = 'match'")
    for m in matches[1:]:
        found = found.unionByName(m.filter("kind = 'match'"))
    return found.select("home", "size", "first", "n", "slot", "per", "at")


def place_pieces(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset; pieces has doc_id, piece, start, length (1 to `length`) and ids_crc32."""
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full, short = pieces.filter(F.col("length") == length), pieces.filter(F.col("length") < length)
    parts = max(1, -(-short.count() // PART_PIECES))
    salts = 8 * parts
    short = short.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).withColumn("home", (F.col("salt") % parts).cast("int"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = short.withColumn("nth", nth)
    # ranks of a length run on through the salts of a part
    size = short.groupBy("length", "home", "salt").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length", "home").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(size.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))))
    runs = before.groupBy("home", F.col("length").alias("size")).agg(F.sum("n").alias("n")).select("home", "size", F.lit(0).cast("long").alias("first"), "n")
    plan = match(runs, length, parts)
    ranked = join_checked(ranked, before.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth"))
    on = (F.col("length") == F.col("size")) & (F.col("home") == F.col("p_home")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    within = F.col("rank") - F.col("first")
    placed = join_checked(ranked, plan.withColumnRenamed("home", "p_home"), on).select(
        *columns, (F.col("slot") + F.floor(within / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + (within % F.col("per")) * F.col("length")).cast("long").alias("offset")
    )
    return placed.unionByName(full.select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, keep: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    Null and empty texts are one piece of the end id. Documents over `length` are cut into pieces, none other.
    Sequences have numbers of their own without holes inside, negative ones where a piece fills one. Rows that repeat a
    doc_id are packed each; rows without one keep null. An empty table gives an empty table; other columns are not read.
    """
    return place_pieces(token_pieces(docs, tokenizer, length, end_id, keep=keep), length)


def assemble(docs: DataFrame, placed: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves; each group is one sequence, so it is bounded."""
    ids = token_pieces(docs, tokenizer, length, end_id, with_ids=True).select("doc_id", "piece", "ids")

    def run(batches):
        for b in slices(batches):
            rows = [np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(rows, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    parts = placed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.col("p.ids").alias("parts")).mapInArrow(run, "sequence_id long, ids array<int>")
