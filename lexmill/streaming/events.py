"""Structured Streaming forms of the event operators; each has the same expression in batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, ts as a timestamp for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_buckets(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events and value a day and type; with a watermark for streams."""
    events = events.withWatermark("ts", watermark) if watermark else events
    days = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return days.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def distinct_events(events: DataFrame, overlap: str = "7 days") -> DataFrame:
    """Each event once, however often overlapping loads bring it within the overlap."""
    return events.withWatermark("ts", overlap).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: start, end and events."""
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
