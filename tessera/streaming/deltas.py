"""Incremental reports as Structured Streaming jobs that run until the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import shared


def run_available(frame: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a streaming frame over all that is available and read what it wrote.

    In update mode each batch is written by its number, so a batch that runs again
    replaces itself; the last state of a key is the one of the last batch.  ``at`` is a
    folder that a later run goes on from (its results and its state); without it there is a new one."""
    spark = frame.sparkSession
    at = at or shared.folder(spark, name)
    out, state = f"{at}/out", f"{at}/state"
    if mode == "append":
        frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(frame.schema).parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b{number:08d}")

    frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/*")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")


def daily_counts(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """Events by UTC day and type, kept up to date; late events count on their day."""
    g = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = run_available(g.select(F.to_date("w.start").alias("day"), "event_type", "n"), "daily", "update", at)
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "batch_no").alias("n"))


def first_seen(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """The keys user, type and hour, each once, across restarts of the stream and however late they come.

    Keys that were seen are a table by day, not state: each batch takes out what is there for its own days (other folders aren't read)
    and adds the rest under its number, so a batch that runs again replaces itself.  Rows without a time have no key."""
    at = at or shared.folder(spark, "seen")
    out = f"{at}/out"
    keys = event_stream(spark, sf_dir).filter("ts is not null").select("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp").alias("hour"))
    schema = keys.schema.add("batch_no", "integer").add("day", "date")

    def seen(session: SparkSession) -> DataFrame:
        path = session._jvm.org.apache.hadoop.fs.Path(out)
        there = path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path)
        return session.read.schema(schema).parquet(out) if there else session.createDataFrame([], schema)

    def write(batch: DataFrame, number: int) -> None:
        new = batch.distinct().withColumn("day", F.to_date("hour")).persist()
        try:
            days = [r[0] for r in new.select("day").distinct().collect()]  # the days of one batch
            old = seen(batch.sparkSession).filter((F.col("batch_no") < number) & F.col("day").isin(days)).select("user_id", "event_type", "hour")
            same = (new["user_id"].eqNullSafe(old["user_id"])) & (new["event_type"].eqNullSafe(old["event_type"])) & (new["hour"] == old["hour"])
            new.join(old, same, "left_anti").write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch_no={number}")
        finally:
            new.unpersist()

    keys.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return seen(spark).select("user_id", "event_type", "hour")
