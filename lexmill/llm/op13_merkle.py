"""Merkle manifest of a table: a hash tree over the documents of each source, and one over the sources.

Trees are built bottom up and proofs pushed top down, over written tables. A table holds STEPS levels of all trees: a
row is a block of 3 ** STEPS consecutive nodes with the levels above them, up to the one node that is a child in the
next table. On the way down each block is joined to the proof of that node, which is the suffix of the proofs of all its
nodes, and each node puts its own siblings before it. A level that all groups have reached the top of is not repeated
for those that have: a lone node goes up as it is. Only DataFrame functions.

Places in a group are numbered without a window over the group: rows are sorted by range over all tasks and numbered
within tasks, and the counts of each task and group give the offsets. So a source with a third of all rows is spread
over a third of the tasks. No task gathers more than a block.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.storage import discard, materialize

FAN, STEPS = 3, 4
BLOCK = FAN**STEPS


def _sized(value: Column) -> Column:
    """A value behind its size in bytes, so that no two rows are written alike."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The leaf of a row of documents, with the text given."""
    return F.sha2(F.concat(*[_sized(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _sized(text)), 256)


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `rank`, from 0 within each group in the order given, and `total`, the rows of the group."""
    placed = materialize(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    counts = placed.groupBy(group, task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(group).alias("_group"), "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    return placed.join(offsets, (placed[group] == offsets["_group"]) & (task == offsets["task"])).withColumn("rank", F.col("at") + F.col("shift")).drop("_group", "task", "at", "shift")


def _parents(nodes: Column) -> Column:
    """The digests over every FAN consecutive nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN)), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def _level(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (group, rank, total, node, and more that stays with the node), each with the levels above it."""
    at = F.struct("rank", *[c for c in nodes.columns if c not in ("group", "rank", "total")])
    blocks = nodes.groupBy("group", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(at)).alias("rows"))
    blocks = blocks.withColumn("level0", F.col("rows.node"))
    for k in range(STEPS):  # where the whole group is one block, levels end at one node
        again = (F.col("total") > BLOCK) | (F.size(f"level{k}") > 1)
        blocks = blocks.withColumn(f"level{k + 1}", F.when(again, _parents(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
    return materialize(blocks)


def _tops(blocks: DataFrame) -> DataFrame:
    return blocks.select("group", F.col("block").alias("rank"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col(f"level{STEPS}")[0].alias("node"))


def build(leaves: DataFrame) -> list[DataFrame]:
    """The written tables of the trees over leaves (group, rank, total, node, ...), lowest first; in the last one each
    group is one block, whose top is the group's root. Of the input only the largest total reaches the driver."""
    levels = [_level(leaves)]
    while (levels[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
        levels.append(_level(_tops(levels[-1])))
    return levels


def _steps(i: Column) -> Column:
    """The siblings of node i of a block at each of its levels, as they stand left and right of the node above i."""
    out = []
    for k in range(STEPS):
        place, nodes = F.floor(i / FAN**k).cast("int"), F.col(f"level{k}")
        left = place % FAN
        step = F.struct(F.array_join(F.slice(nodes, place - left + 1, left), "").alias("left"), F.array_join(F.slice(nodes, place + 2, FAN - 1 - left), "").alias("right"))
        # the level above is the level itself where a tree has ended
        out.append(F.when((F.col("total") > BLOCK) | (F.size(nodes) > 1), step))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def push_down(levels: list[DataFrame], proofs: DataFrame) -> DataFrame:
    """Each leaf's columns (in `row`) with its proof, array<struct<left, right>> from the leaf to the root.

    proofs (group, proof, ...) has the proofs of the groups' roots; its further columns reach the leaves too.
    """
    more = [c for c in proofs.columns if c not in ("group", "proof")]
    suffix = proofs.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(levels):
        nodes = F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: F.struct(F.col("rows")[i].alias("row"), F.concat(_steps(i), F.col("proof")).alias("proof")))
        found = blocks.join(suffix, ["group", "block"]).select("group", *more, F.explode(nodes).alias("x"))
        suffix = found.select("group", F.col("x.row.rank").alias("block"), F.col("x.proof").alias("proof"), *more, *([F.col("x.row").alias("row")] if blocks is levels[0] else []))
    return suffix.drop("block")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs.

    docs has doc_id, source, lang, n_chars and text. Where 2 divides the crc32 of the decimal doc_id the text is tampered
    with: its line ends are deleted. The root is folded from the leaf of what is then there and the siblings of the
    original. Nulls in any column are written `-`; a null source is a group of its own, before all others; a null doc_id
    comes first in its source and isn't tampered with, as is a null text. Rows with the same doc_id are ordered by their
    leaves; repeated rows are leaves of their own. Texts are hashed whole. A lone document is the root of its source,
    with no siblings. An empty table gives an empty one; other columns are not read.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "n_chars")], text.alias("text"))
    tampers = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    found = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("group"),  # in the order of sources, null first
        "doc_id",
        leaf_digest(F.col("text")).alias("node"),
        F.when(tampers, leaf_digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered"),
        F.monotonically_increasing_id().alias("nth"),  # else rows that repeat could not be dealt out
    )
    leaves = materialize(found)
    levels = build(_numbered(leaves, "group", ["doc_id", "node", "nth"]).drop("nth"))
    discard(leaves)
    sources = _tops(levels[-1]).select(F.lit("").alias("group"), F.col("group").alias("source"), "node")
    above = build(_numbered(sources, "group", ["source"]))
    root = _tops(above[-1]).select("group", F.lit(None).cast("array<struct<left:string,right:string>>").alias("proof"), F.col("node").alias("root"))
    root = root.withColumn("proof", F.array().cast("array<struct<left:string,right:string>>"))
    proofs = push_down(above, root).select(F.col("row.source").alias("group"), "proof", F.col("row.node").alias("subroot"), "root")
    siblings = F.array_join(F.flatten(F.transform("proof", lambda s: F.array(s["left"], s["right"]))), "")
    folded = F.aggregate("proof", F.coalesce("row.tampered", "row.node"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    out = push_down(levels, materialize(proofs)).select("row.doc_id", F.col("row.node").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
