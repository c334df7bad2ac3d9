"""Tables and intermediate results in storage that every executor can read."""

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

#: Bytes up to which a written and measured table may be broadcast.
BROADCAST_BYTES = 32_000_000
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a session on one machine (local master) gets a new
    one; on a cluster that is an error, as executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lexmill-"))
    return _own[0]


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders `name`=n in a folder that were written to the end; none where there is no such folder."""
    where, system = _file_system(spark, path)
    if not system.exists(where):
        return []
    done = [s.getPath() for s in system.listStatus(where) if s.isDirectory() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n) for p in done for k, _, n in [p.getName().partition("=")] if k == name)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/lexmill-{uuid.uuid4().hex}"
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that outlives executors: a lost executor costs the tasks that it ran, and
    never a recomputation of what is written here. The files go when the driver ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for the frames, once nothing will read it again."""
    for df in frames:
        if path := getattr(df, "_lexmill_path", None):
            where, system = _file_system(df.sparkSession, path)
            system.delete(where, True)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of df's values, with 16 for each column of each row besides."""
    wide = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema if not isinstance(f.dataType, NumericType | BooleanType)]
    row = reduce(lambda a, b: a + b, wide, F.lit(16 * len(df.columns)))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a small but unbounded right side: it is written and measured, and broadcast only up to `most` bytes.

    Beyond that it is a plain shuffled join, whose hot keys adaptive execution splits.
    """
    right = materialize(right)
    return left.join(F.broadcast(right) if measured_bytes(right) <= most else right.hint("merge"), on, how)
