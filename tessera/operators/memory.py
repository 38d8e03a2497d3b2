"""Operators on what is remembered: views, suppression, duplicates, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import text_key

# Sources of memories that are a person's own; kinds that research writes itself, and how many of them a block of lessons holds.
PERSONAL = ("chat", "answer", "manual")
CONTENT_KINDS, CONTENT_SLOTS = ("pattern", "dead_end"), 3
LESSON_KINDS = ("pattern", "dead_end", "search_lesson", "source_lesson")


def views(memories: DataFrame, active_focus: DataFrame) -> DataFrame:
    """view and memory_id: user, research and recon of the confirmed active ones, and declined.

    A memory from the web shows only under its own focus; without an active focus none does."""
    m = memories.join(active_focus.select(F.col("focus_id").alias("now")), F.col("source") == "recon", "left")
    live = F.col("confirmed") & F.col("active")
    shown = [
        F.when(live & F.col("source").isin(*PERSONAL), F.lit("user")), F.when(live & (F.col("source") == "research"), F.lit("research")),
        F.when(live & (F.col("source") == "recon") & (F.col("focus_id") == F.col("now")), F.lit("recon")), F.when(~F.col("confirmed") & ~F.col("active"), F.lit("declined")),
    ]
    return m.select(F.explode(F.array_compact(F.array(*shown))).alias("view"), "memory_id")


def not_declined(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """Proposals whose text, whatever its case and blanks, was not declined before."""
    keys = memories.filter("not confirmed and not active").select(text_key(F.col("text")).alias("key")).distinct()
    return proposals.withColumn("key", text_key(F.col("text"))).join(keys, "key", "left_anti").drop("key")


def lessons(memories: DataFrame) -> DataFrame:
    """Active lessons from research with a key."""
    return memories.filter("source = 'research' and active and text_key is not null")


def repeated_lessons(memories: DataFrame) -> DataFrame:
    """memory_id of active lessons whose key an older active one has."""
    own = lessons(memories).select("memory_id", "text_key")
    first = own.groupBy("text_key").agg(F.min("memory_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return own.join(first, "text_key").filter("memory_id > first").select("memory_id")


def ids(c: Column) -> Column:
    return F.from_json(c, "array<bigint>")


def merged(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """memory_id and claim_ids (sorted, each once) of lessons that proposals repeat: what either rests on."""
    first = lessons(memories).groupBy("text_key").agg(F.min_by(F.struct("memory_id", "claim_ids"), "memory_id").alias("m"))
    met = proposals.select(text_key(F.col("text")).alias("text_key"), F.explode(ids(F.col("claim_ids"))).alias("claim_id")).distinct().join(first, "text_key")
    own = met.select("m.memory_id", F.explode(F.concat(ids(F.col("m.claim_ids")), F.array("claim_id"))).alias("claim_id")).distinct()
    return own.groupBy("memory_id").agg(F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))  # a lesson rests on claims that a prompt held


def quota(lessons: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first k lessons of each group in their order, of which CONTENT_SLOTS at most are of a content kind; ``place`` counts from 1."""
    from pyspark.sql.window import Window

    content = F.col("kind").isin(*CONTENT_KINDS)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = lessons.withColumn("content", F.sum(content.cast("int")).over(w)).filter(~content | (F.col("content") <= CONTENT_SLOTS)).drop("content")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("place") <= k)
