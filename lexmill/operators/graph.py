"""Connected components of an edge table, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.storage import discard, materialize


def _contract(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return (
        large.join(least, "u")
        .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .filter("u != v")
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Each round is two grouped minima and two joins over at most as many rows as edges; the number of rounds grows
    with the logarithm of the diameter. Edges, labels and components stay in distributed tables; only two numbers
    a round (row count and checksum) reach the driver. Null ends and self loops are dropped.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"))
    seen = now.agg(mark.alias("m")).first()["m"]
    for _ in range(max_rounds if seen["n"] else 0):
        nxt = materialize(_contract(now))
        mark_now = nxt.agg(mark.alias("m")).first()["m"]
        discard(now)
        now = nxt
        if mark_now == seen:
            break
        seen = mark_now
    else:
        if seen["n"]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return labels.unionByName(roots)
