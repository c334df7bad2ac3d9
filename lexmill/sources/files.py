"""Sources and sinks: declared schemas over files, archives and snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField(n, T.LongType() if n in ("doc_id", "n_chars") else T.StringType()) for n in ("doc_id", "text", "lang", "source", "n_chars")])


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """parquet, orc, json, csv, text, jdbc or binaryFile; with a schema nothing is inferred."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_archive(df: DataFrame, path: str, by: list[str]) -> None:
    """Compressed JSON lines, a folder for each value of `by`, appended."""
    df.write.mode("append").partitionBy(*by).option("compression", "gzip").json(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    df.write.mode("overwrite").format(kind).partitionBy(*(by or [])).save(path)


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the shape of schema: columns that it lacks are null, unknown ones are refused."""
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def sniff(content):
    """The kind of a binary file by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("text")
    for mark, kind in (("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0", "ole"), ("52617221", "rar"), ("1F8B", "gzip")):
        out = F.when(F.startswith(head, F.lit(mark)), kind).otherwise(out)
    return out
