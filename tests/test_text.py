"""Text functions."""

from pyspark.sql import functions as F

from lexmill.functions import text as T


def test_chunks_cover_long_texts(spark):
    frame = spark.createDataFrame([("x" * 50_100,)], "t string")
    assert frame.select(F.size(T.chunks(F.col("t"))), F.size(T.chunks(F.col("t"), most=40))).first()[:] == (100, 40)
