"""Writing operations as tables: what a merge, an insert, a rebuild or a copy leaves behind."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks; of new rows with one key the least counts."""
    fresh = new.join(old, keys, "left_anti")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys]))
    return old.unionByName(fresh.withColumn("_nth", nth).filter("_nth = 1").drop("_nth"))


def rebuild(old: DataFrame, new: DataFrame, key: str, keep: Column) -> DataFrame:
    """old without the rows of rebuilt keys (those marked by keep stay), and new."""
    return old.join(new.select(key).distinct().withColumn("_rebuilt", F.lit(True)), key, "left").filter(F.col("_rebuilt").isNull() | keep).drop("_rebuilt").unionByName(new)


def cascade_delete(gone: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The tables without the rows that name a key in gone; each comes with its column of that key."""
    return {name: df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti") for name, (df, column) in tables.items()}


def partial_upsert(old: DataFrame, new: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """old with the allowed columns that new has, where they are not null; unknown columns are not taken."""
    present = [c for c in allowed if c in new.columns and c in old.columns]
    both = old.join(new.select(key, *[F.col(c).alias(f"_{c}") for c in present]), key, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in present else F.col(c) for c in old.columns])


def row_digest(columns: list[str]) -> Column:
    """md5 over the columns as text, null as a mark of its own."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]).cast("binary"))


def copy_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, difference) of rows that a copy lacks, has besides or has otherwise."""
    columns = [c for c in a.columns if c != key]
    x, y = (df.select(key, row_digest(columns).alias(n)) for df, n in ((a, "left_digest"), (b, "right_digest")))
    kind = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").when(F.col("left_digest") != F.col("right_digest"), "changed")
    return x.join(y, key, "full_outer").select(key, kind.alias("difference")).filter("difference is not null")


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and a sum of row digests that no order changes."""
    part = F.conv(F.substring(row_digest(columns), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.sum(part).cast("long").alias("digest"))


def first_by_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key, null being a key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")
