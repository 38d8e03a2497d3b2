"""Reports with stored marks: what a report covers and how far it goes are one commit.

Each batch writes one table under its number, which holds the report's rows and, in each, the mark before and after it.  A
table counts when it is complete (_SUCCESS), so there is no state between report and mark: a batch that fails has neither,
and one that runs again starts from the mark before it and replaces its own table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import shared

REPORT = "what string, n long, late long, since timestamp, until timestamp, batch_no long"


def committed(spark: SparkSession, at: str, before: int | None = None) -> DataFrame:
    """The rows of all complete reports in a folder, or of those of batches before a number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath().getParent().toString() for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/b*/_SUCCESS")) or []]
    rows = spark.read.schema(REPORT).parquet(*done) if done else spark.createDataFrame([], REPORT)
    return rows if before is None else rows.filter(F.col("batch_no") < before)


def mark(spark: SparkSession, at: str, before: int | None = None) -> datetime | None:
    """How far complete reports go; none before the first."""
    return committed(spark, at, before).agg(F.max("until")).first()[0]


def reported(events: DataFrame, at: str | None = None, deliver: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Reports on a stream of events (ts, what): one row for each batch and kind, with what happened after the mark and what came late.

    Each event is in one report, in ``late`` if its time isn't after the mark.  ``deliver`` gets the rows of a report before they are
    committed; where it fails the mark stays, and the next run delivers again.  A batch without events has no rows and moves nothing."""
    spark = events.sparkSession
    at = at or shared.folder(spark, "reports")

    def write(batch: DataFrame, number: int) -> None:
        # the session of the batch, and what was complete before it
        since = mark(batch.sparkSession, f"{at}/out", number)
        old = F.coalesce(F.col("ts") <= F.lit(since).cast("timestamp"), F.lit(False))
        rows = batch.filter("ts is not null").groupBy("what").agg(F.sum((~old).cast("long")).alias("n"), F.sum(old.cast("long")).alias("late"), F.max("ts").alias("last"))
        until = rows.agg(F.max("last").alias("until"))  # one row
        rows = rows.crossJoin(F.broadcast(until)).select("what", "n", "late", F.lit(since).cast("timestamp").alias("since"), F.greatest(F.lit(since).cast("timestamp"), "until").alias("until"), F.lit(number).cast("long").alias("batch_no"))
        rows.persist()
        try:
            if deliver:
                deliver(rows, number)
            rows.write.mode("overwrite").parquet(f"{at}/out/b{number:08d}")
        finally:
            rows.unpersist()

    run = events.select("ts", "what").writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return committed(spark, f"{at}/out")
