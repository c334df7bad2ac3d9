"""Tables kept up to date by a stream, in batches that can be played again.

A held table is a folder of plain files: `rows` with what each batch changed, `rejected` with what it could not take,
`progress` with a row of counts for each batch, and `snapshots` of the whole. A batch only reads what batches before it
left, and writes its own folders anew, so playing it again, as a stream does after a failure, changes nothing. What is held
of a key is its row of the latest time, so rows may come in any order within the delay; later ones are rejected, and stay
readable.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexmill.operators import postings as P
from lexmill.operators.maintenance import row_digest
from lexmill.plans.storage import folders

_PROGRESS = "latest timestamp, n_rows long, n_rejected long, n_new long, n_updated long, n_unchanged long, n_older long"


@dataclass(frozen=True)
class Held:
    """The held table at `path` of rows of `schema`: one of each `key`, by `time`, then by the columns `ties`, then by
    content. Rows more than `delay` behind the latest time of earlier batches are too late."""

    path: str
    schema: StructType
    key: str
    time: str
    ties: tuple[str, ...] = ()
    delay: str = "7 days"

    def _order(self) -> Column:
        return F.struct(F.col(self.time), *[F.col(c) for c in self.ties], row_digest(self.schema.names))

    def _part(self, spark: SparkSession, name: str, schema, before: int | None, after: int = -1) -> DataFrame:
        """The folders of batches after one and before another."""
        at = [f"{self.path}/{name}/batch={n}" for n in folders(spark, f"{self.path}/{name}", "batch") if n > after and (before is None or n < before)]
        read = spark.read.schema(schema)
        found = read.option("basePath", f"{self.path}/{name}").parquet(*at) if at else spark.createDataFrame([], schema).withColumn("batch", F.lit(None))
        return found.withColumn("batch", F.col("batch").cast("long"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        one = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in self.schema.names if c != self.key]), self._order()).alias("r"))
        return one.select(*[F.col(c) if c == self.key else F.col(f"r.{c}").alias(c) for c in self.schema.names])

    def now(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """What is held, or was held before a batch: the newest snapshot and the changes after it."""
        snapshots = [n for n in folders(spark, f"{self.path}/snapshots", "batch") if before is None or n < before]
        upto = max(snapshots, default=-1)
        rows = self._part(spark, "rows", self.schema, before, upto).select(*self.schema.names)
        if snapshots:
            rows = rows.unionByName(spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/batch={upto}"))
        return self._latest(rows)

    def rejected(self, spark: SparkSession) -> DataFrame:
        """Rows that were not taken, with batch and reason: late, or without key or time."""
        return self._part(spark, "rejected", StructType([*self.schema.fields, StructField("reason", StringType())]), None)

    def progress(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return self._part(spark, "progress", _PROGRESS, before)

    def changes(self, spark: SparkSession, batch: int) -> DataFrame:
        """What a batch changed."""
        return self._part(spark, "rows", self.schema, batch + 1, batch - 1).select(*self.schema.names)

    def snapshot(self, spark: SparkSession) -> None:
        """Write what is held as of the last batch that ended, so that reading it no longer grows with its history."""
        done = folders(spark, f"{self.path}/progress", "batch")
        if done:
            self.now(spark, max(done) + 1).write.mode("overwrite").parquet(f"{self.path}/snapshots/batch={max(done)}")

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Take in a batch: for foreachBatch, which gives it the same number when it is played again."""
        spark = rows.sparkSession
        rows = rows.select(*self.schema.names)
        latest = self.progress(spark, batch).agg(F.max("latest")).first()[0]
        late = F.lit(False) if latest is None else F.col(self.time) < F.lit(latest) - F.expr(f"INTERVAL {self.delay}")
        reason = F.when(F.col(self.key).isNull(), "no key").when(F.col(self.time).isNull(), "no time").when(late, "late")
        rows = rows.withColumn("reason", reason).persist()
        try:
            taken = self._latest(rows.filter("reason is null").drop("reason"))
            held = self.now(spark, batch).select(self.key, self._order().alias("held"), row_digest(self.schema.names).alias("held_digest"))
            both = taken.join(held, self.key, "left").withColumn("mine", self._order())
            change = F.when(F.col("held").isNull(), "new").when(F.col("held_digest") == row_digest(self.schema.names), "unchanged").when(F.col("mine") > F.col("held"), "updated").otherwise("older")
            both = both.withColumn("change", change).drop("held", "held_digest", "mine").persist()
            both.filter("change IN ('new', 'updated')").select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
            rows.filter("reason is not null").write.mode("overwrite").parquet(f"{self.path}/rejected/batch={batch}")
            counts = both.agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("new", "updated", "unchanged", "older")])
            seen = rows.agg(F.max(F.when(F.col("reason").isNull(), F.col(self.time))).cast("timestamp").alias("latest"), F.count("*").alias("n_rows"), F.count("reason").alias("n_rejected"))
            seen.crossJoin(F.broadcast(counts)).write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch}")  # one row of each
            both.unpersist()
        finally:
            rows.unpersist()

    def run(self, stream: DataFrame, checkpoint: str, after: Callable[[SparkSession, int], None] | None = None, timeout: int | None = None) -> None:
        """Take in all that a stream has now; `after` is called with the number of each batch that was taken in."""

        def take(rows: DataFrame, batch: int) -> None:
            self.apply(rows, batch)
            if after:
                after(rows.sparkSession, batch)

        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError("the stream did not end in time")


def index_changes(held: Held, index: str, columns: dict[str, Column]) -> Callable[[SparkSession, int], None]:
    """Keeps the posting index at `index` up to date with a held table of documents, whose key is doc_id: of each batch only
    what changed by content is indexed, as a generation of the batch's number."""

    def after(spark: SparkSession, batch: int) -> None:
        P.append(held.changes(spark, batch).select(*[e.alias(c) for c, e in columns.items()]), index, batch)

    return after
