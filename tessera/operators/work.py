"""Queue, usage, window and change-mark operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources import shared


def percentiles_by_offset(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the values at offsets floor(n q) (from 0) of its sorted non-null values; null without any.

    Equal values are counted first.  Rows are then dealt by range, ranked within their
    range, and moved on by the counts of the ranges before, so that no task holds a group."""
    groups = df.select(by).distinct()
    counted = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    ranges = shared.written(counted.repartitionByRange(F.col(by), F.col(value)).withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(by, "range").agg(F.sum("n").alias("s"))  # a row for a group and a range
    before = F.sum("s").over(Window.partitionBy(by).orderBy("range")) - F.col("s")
    sums = sums.select(by, "range", before.alias("before"), F.sum("s").over(Window.partitionBy(by)).alias("total"))
    last = F.sum("n").over(Window.partitionBy(by, "range").orderBy(value))
    at = ranges.withColumn("last", last).join(sums, [by, "range"]).withColumn("last", F.col("last") + F.col("before"))
    spot = {name: F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(q))) for name, q in shares.items()}
    found = [F.max(F.when((F.col("last") > c) & (F.col("last") - F.col("n") <= c), F.col(value))).alias(name) for name, c in spot.items()]
    return groups.join(at.groupBy(by).agg(*found), by, "left")


def first_n(df: DataFrame, by: list[str], order: list, n: int, name: str = "position") -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def within_budget(df: DataFrame, by: str, order: Column, size: Column, budget: int) -> DataFrame:
    """Newest rows of each group while their sizes together fit; the newest always stays."""
    w = Window.partitionBy(by).orderBy(order)
    df = df.withColumn("position", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.filter((F.col("position") == 1) | (F.col("used") <= budget))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; non-null columns of the new rows replace the old ones."""
    n = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in key])
    joined = old.join(n, key, "full_outer")
    return joined.select(*key, *[F.coalesce(f"new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c not in key])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key isn't there yet, one for each key."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def retry_delay(attempts: Column, base: float = 30.0) -> Column:
    """Seconds until the next attempt: base, doubled for every attempt after the first."""
    return F.lit(base) * F.pow(F.lit(2.0), attempts - 1)


def allowances(outcomes: Column, cap: int) -> Column:
    """What each allowance from 1 to cap becomes by a replay: halved under pressure, one more after success, within 1..cap."""
    one = lambda a, pressed: F.when(pressed, F.greatest(F.lit(1), F.floor(a / 2).cast("int"))).otherwise(F.least(F.lit(cap), a + 1))
    return F.transform(F.sequence(F.lit(1), F.lit(cap)), lambda start: F.aggregate(outcomes, start, one))


def answer_action(same: Column, sufficient: Column, articles: Column, blocked: Column, rounds: Column, human_queue: int, max_rounds: int, waiting: Column) -> Column:
    """What follows an answer round."""
    over = F.when(waiting >= human_queue, "open").otherwise("escalate")
    return (
        F.when(same, "search_again").when(sufficient.isNull(), "search_again").when(sufficient & (articles >= 2), "answer")
        .when(blocked | (rounds >= max_rounds), over).otherwise("search_again")
    )
