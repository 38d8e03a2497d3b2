"""What each filter removes in every order of the filters, and what it removes that no other does.

All that an order can tell of a filter depends on which filters each document fails: documents are counted by part and
failure mask, in Spark, and the orders are walked over these cells.  Neighbouring orders of the walk differ by one swap of
adjacent filters, which changes the set of filters applied so far at one place only: two steps are worked out anew.  A
filter's Shapley sum grows along the walk by what it removes in each order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import small_batches, trimmed, written

#: The filters' letters; the bit of letter k is 1 << k.
FILTERS = "ABCDE"
#: Parts whose orders are walked together.
PARTS = 128
MEASURES = ("n", "good", "toxic")
#: What a word is in the filters of words.
GAP = r"[\x20\x09-\x0D]+"


def swaps(n: int) -> Iterator[int]:
    """Places k of the swaps (k, k+1) that lead through all orders of n things, each seen once."""
    order, way = list(range(n)), [-1] * n
    while True:
        # the largest thing that looks at a smaller neighbour moves; all larger ones turn round
        free = [x for at, x in enumerate(order) if 0 <= at + way[x] < n and order[at + way[x]] < x]
        if not free:
            return
        big = max(free)
        at = order.index(big)
        to = at + way[big]
        order[at], order[to] = order[to], order[at]
        for x in range(big + 1, n):
            way[x] = -way[x]
        yield min(at, to)


def walk(cells: np.ndarray, letters: str) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """All orders of the filters over cells[part, mask, measure]; each gives arrays [part, step] by name, the last value is ``shapley`` [part, filter] alone.

    ``passed[part, set]`` has the documents that fail nothing in a set of filters, so a step is a difference of two of its columns."""
    n = len(letters)
    passed = cells[:, ::-1].copy()  # by the set of filters that may not be failed: its complement may be
    for k in range(n):
        with_k = np.flatnonzero(np.arange(1 << n) >> k & 1)
        passed[:, with_k ^ (1 << k)] += passed[:, with_k]
    # now passed[:, s] sums cells whose failures lie within the complement of s
    fails = passed[:, :1, 0] - passed[:, [1 << k for k in range(n)], 0]
    alone = cells[:, [1 << k for k in range(n)], 0]
    order = list(range(n))
    kept, removed = np.zeros((len(cells), n), np.int64), np.zeros((len(cells), n, len(MEASURES)), np.int64)
    shapley, credited, visit = np.zeros((len(cells), n), np.int64), [0] * n, 0

    def credit(k: int) -> None:
        """The filter at step k has removed as much in each order since it was credited."""
        f = order[k]
        shapley[:, f] += removed[:, k, 0] * (visit - credited[f])
        credited[f] = visit

    def work_out(k: int) -> None:
        before = sum(1 << f for f in order[:k])
        after = before | 1 << order[k]
        kept[:, k] = passed[:, after, 0]
        removed[:, k] = passed[:, before] - passed[:, after]

    def shown() -> tuple[str, dict[str, np.ndarray]]:
        return "".join(letters[f] for f in order), {
            "kept": kept.copy(), "removed": removed[..., 0].copy(), "redundant": fails[:, order] - removed[..., 0], "unique_fails": alone[:, order],
            "good_lost": removed[..., 1].copy(), "toxic_lost": removed[..., 2].copy(),
        }

    for k in range(n):
        work_out(k)
    yield shown()
    for k in swaps(n):
        visit += 1
        credit(k)
        credit(k + 1)
        order[k], order[k + 1] = order[k + 1], order[k]
        work_out(k)
        work_out(k + 1)
        yield shown()
    visit += 1
    for k in range(n):
        credit(k)
    yield "", {"shapley": shapley}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def orders(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step from cells (part, mask, n, good, toxic), one row per part and mask at most.

    A part's cells are 2 ** filters rows at most, and so is what a task gets of it; parts are walked some at a time as arrays."""
    n = len(letters)
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, PARTS) for at in range(0, len(whole), PARTS)):
                lists = batch.column(1)
                of = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
                each = lists.flatten()
                dense = np.zeros((len(batch), 1 << n, len(MEASURES)), np.int64)
                for k, name in enumerate(MEASURES):
                    dense[of, each.field("mask").to_numpy(), k] = each.field(name).to_numpy()
                seen = list(walk(dense, letters))
                shapley = seen.pop()[1]["shapley"]
                rows = len(seen) * n
                names = np.array([name for name, _ in seen])
                which = np.array([[letters.index(x) for x in name] for name, _ in seen])
                columns = {c: np.stack([x[c] for _, x in seen], 1).reshape(-1) for c in COUNTS[:-1]} | {"shapley": shapley[:, which].reshape(-1)}
                part = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), rows)))
                arrays = [part, pa.array(np.tile(np.repeat(names, n), len(batch))), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(batch) * len(seen))), *(pa.array(columns[c]) for c in COUNTS)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *COUNTS])

    small_batches(cells.sparkSession)
    return packed.mapInArrow(trimmed(walked), SCHEMA)


def failures(text: Column) -> dict[str, Column]:
    """The conditions that look at one text, by letter: too short, repetitive, shouting, markup."""
    words = F.array_remove(F.split(text, GAP), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part (source) and failure mask, with those that labels call good (quality 1) and toxic.

    Texts are read once and leave their scan as 16-byte hashes; equal rows are summed before anything is shuffled, and what
    a text's rows share (its smallest id) is found over sums.  E is failed by rows whose id is larger than the smallest id
    of an equal text."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(failed, 1 << FILTERS.index(letter)).otherwise(0) for letter, failed in failures(F.col("t")).items()]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("id", "part", F.unhex(F.md5("t")).alias("same"), sum(bits[1:], bits[0]).alias("mask"))
    rows = written(rows.groupBy("id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = written(known.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")), "audit-labels")
    marked = rows.join(known, "id", "left").na.fill(0, ["good", "toxic"])
    groups = marked.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    groups = written(groups, "audit-groups")
    least = groups.groupBy("same").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("k"))
    several = written(least.filter("k > 1").select("same", "least"), "audit-texts")  # a text of one group has its least id there
    first = F.coalesce(F.col("first") == F.coalesce("least", "first"), F.lit(False))
    counted = groups.join(several, "same", "left").withColumn("stay", F.col("n_null") + F.when(first, F.col("n_first")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    each = counted.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "c.mask", "c.n", (F.col("c.n") * F.col("good")).alias("good"), (F.col("c.n") * F.col("toxic")).alias("toxic"))
    return each.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in MEASURES))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over documents, by source: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is an empty one, a null source an empty one.  Rows without an id equal no smaller id's text and have no label;
    rows that repeat an id are counted each, and none of them copies another with its id.  Of labels that repeat an id, one
    that says good or toxic is enough; null marks say nothing.  An empty table gives no rows; other columns are ignored.
    """
    return orders(cells_of(docs, labels))
