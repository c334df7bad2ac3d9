"""Embedding near-duplicates by p-stable hashing for Euclidean distance, with exact cosine checks.

A hash is floor((a . v + b) / w) of the normalised vector v with Gaussian a and uniform b; a table's bucket is the
tuple of `hashes` such values. Vectors at cosine 0.95 lie 0.316 apart and share one hash with width 1.5 with
probability 0.83; 30 tables of 12 hashes therefore bring 97 % of pairs at the very threshold together, and at cosine
0.97 over 99.8 %. Vectors of one bucket are compared exactly in double precision.

Buckets, and afterwards the components that links make, are worked in blocks of bounded size, a large one by pairs of
blocks; only spanning forests and counts leave a block. Equal vectors are one row with a count before any of this, so
a group of copies, however large, is one vector to compare. Counting links within components also finds pairs that no
table brought together.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import forest, slices, sorted_groups
from lexmill.operators.graph import connected_components
from lexmill.plans.storage import join_checked, materialize

BLOCK = 512


def _unit(column: pa.Array) -> list:
    """Unit vectors in double precision; None for those that link with nothing."""
    out = []
    for v in column.to_pylist():
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        if x is not None and len(x) and np.isfinite(x).all():
            top = np.abs(x).max()
            out.append(x / top / np.linalg.norm(x / top) if top > 0 else None)
        else:
            out.append(None)
    return out


def _vectors(df: DataFrame) -> DataFrame:
    """(vec_id, dims, unit): usable vectors as packed doubles."""

    def run(batches):
        for b in slices(batches, 4096):
            keep = [(i, u) for i, u in zip(b.column("vec_id").to_pylist(), _unit(b.column("embedding")), strict=True) if u is not None and i is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in keep], pa.int64()), pa.array([len(u) for _, u in keep], pa.int32()), pa.array([u.tobytes() for _, u in keep], pa.binary())], ["vec_id", "dims", "unit"]
            )

    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, dims int, unit binary")


def _buckets(vectors: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """(t, bucket, unit_id): the bucket of each vector in each table."""

    def run(batches):
        drawn: dict[int, tuple] = {}
        for b in slices(batches, 4096):
            dims, ids = b.column("dims").to_numpy(), b.column("vec_id").to_numpy()
            units = b.column("unit").to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in drawn:
                    rng = np.random.default_rng([seed, d])
                    drawn[d] = rng.standard_normal((d, tables * hashes)), rng.uniform(0, width, tables * hashes)
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(-1, d)
                q = np.floor((x @ drawn[d][0] + drawn[d][1]) / width).astype(np.int64).reshape(len(at), tables, hashes)
                mix = np.random.default_rng([seed, 1]).integers(1, 1 << 62, hashes) | 1
                with np.errstate(over="ignore"):
                    code = (q * mix).sum(axis=2) + d
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(code.ravel()), pa.array(np.repeat(ids[at], tables))], ["t", "bucket", "vec_id"]
                )

    return vectors.mapInArrow(run, "t int, bucket long, vec_id long")


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups of two or more by keys, dealt to (keys, i, j): a large group by pairs of its blocks."""
    size = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("own")
    return (
        join_checked(rows, size, keys)
        .select(*keys, "vec_id", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id")
    )


def _to_numpy(name, column):
    return np.array(column.to_pylist(), object) if name == "unit" else column.to_numpy(zero_copy_only=False)


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _groups(batches, keys, columns=("own", "vec_id", "unit")):
    for rows, starts in sorted_groups(batches, keys, list(columns), _to_numpy):
        for a, b in zip(starts, [*starts[1:], len(rows["vec_id"])], strict=True):
            if b - a > 1 and len({len(u) for u in rows["unit"][a:b]}) == 1:
                yield {k: v[a:b] for k, v in rows.items()}


def _forests(threshold: float):
    def run(batches):
        for g in _groups(batches, ["t", "bucket", "i", "j"]):
            x = _matrix(g["unit"])
            root = forest(x @ x.T >= threshold)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(g["vec_id"][at]), pa.array(g["vec_id"][root[at]])], ["src", "dst"])

    return run


def _counts(threshold: float):
    def run(batches):
        for g in _groups(batches, ["component", "i", "j"], ("own", "vec_id", "unit", "copies")):
            x, i, j, own = _matrix(g["unit"]), g["i"][0], g["j"][0], g["own"]
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if i != j:  # links within one block are counted where i = j
                near &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(g["vec_id"]), pa.array(near @ g["copies"])], ["vec_id", "n"])

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.95, tables: int = 30, hashes: int = 12, width: float = 1.5, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df with (vec_id, embedding).

    n_links counts the other vectors at cosine >= threshold, component_id is the smallest vec_id reachable by links
    and kept tells whether that is the vector itself. Vectors that are null, empty or zero, or that hold nulls or
    non-finite numbers, link with nothing; so do vectors of different length. vec_id is taken as a key: of rows
    that repeat one, the least usable vector counts (as packed bytes, shorter ones first) and each row is returned. An empty table gives an empty table; other
    columns are not read. More hashes a table suit a larger corpus, with more tables to hold the recall.
    """
    least = _vectors(df).groupBy("vec_id").agg(F.min(F.struct("dims", "unit")).alias("v")).select("vec_id", "v.dims", "v.unit")
    vectors = materialize(least.withColumn("same", F.sha2("unit", 256)))
    classes = materialize(vectors.groupBy("same", "dims", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    units = classes.select("vec_id", "unit", "copies")
    found = _blocks(_buckets(classes.select("vec_id", "dims", "unit"), tables, hashes, width, seed), ["t", "bucket"])
    ordered = lambda d, keys: d.repartition(*keys).sortWithinPartitions(*keys)
    keys = ["t", "bucket", "i", "j"]
    edges = ordered(found.join(units.drop("copies"), "vec_id"), keys).select(*keys, "own", "vec_id", "unit").mapInArrow(_forests(threshold), "src long, dst long")
    parts = materialize(connected_components(edges.distinct()).withColumnRenamed("node", "vec_id"))
    keys = ["component", "i", "j"]
    dealt = _blocks(parts, ["component"])
    links = (
        ordered(dealt.join(units, "vec_id"), keys)
        .select(*keys, "own", "vec_id", "unit", "copies")
        .mapInArrow(_counts(threshold), "vec_id long, n long")
        .groupBy("vec_id")
        .agg(F.sum("n").alias("n_links"))
    )
    of_class = (
        classes.select("same", "vec_id", "copies")
        .join(parts, "vec_id", "left")
        .join(links, "vec_id", "left")
        .select("same", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    )
    known = vectors.select("vec_id", "same").join(of_class, "same").drop("same")
    return (
        df.select(F.col("vec_id").cast("long"))
        .join(known, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
