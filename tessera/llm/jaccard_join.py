"""Exact Jaccard self-join of shingle sets: size-aware, light sets and heavy sets apart.

Two sets of n <= m shingles link if 100 |r and s| >= 80 |r or s|, that is if they
share c(n, m) shingles or more.  Pairs whose smaller set has at most L shingles
(light) are found by enumerating the c-subsets of both sets, which proves the
link; all other pairs by scanning inverted lists of prefix shingles, followed by
an exact count.  L minimises the estimated cost over the sizes that occur.
Shingles that very many documents have come last in the prefix order, so that
shared passages make no long lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import mix, shingle_sets
from tessera.llm.buckets import ENTRY, exchange, groups_of
from tessera.llm.linking import FOUND, HOT, INDEXED, LIGHT, PROBED, linked_components, receive
from tessera.llm.runtime import key_filter, may_have, small_batches, trimmed, written

#: A shingle in at least this share of all documents is frequent: 1 / FREQUENT sets of the mean size bound how many there are.
FREQUENT = 1e-3
#: Shingles that a task holds while it counts.
COUNTED = 1_500_000
#: Sets with more shingles are never light.
MOST_LIGHT = 12


def needed(n: int, m: int, percent: int = 80) -> int:
    """Shingles that sets of n and m shingles must share."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int = 80) -> range:
    """Sizes of the sets that a set of n shingles can link with."""
    return range(-(-n * percent // 100), n * 100 // percent + 1)


def common(n: int) -> int:
    """Prefix shingles that a pair must share whose smaller set has n shingles.

    A longer prefix by so many makes sharing so many necessary; one shared line or
    passage of other texts then isn't enough to make a candidate."""
    return 1 + n // 20


def prefix(n: int, percent: int = 80) -> tuple[int, int]:
    """Lengths of a set's probed prefix and of its indexed prefix (as the smaller set of a pair)."""
    more = common(n)
    return min(n, n - -(-n * percent // 100) + more), min(n, n - -(-2 * percent * n // (100 + percent)) + more)


def light_keys(n: int, bound: int, percent: int = 80) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) for all pairs of a set of n shingles that are light."""
    return [(min(n, m), max(n, m), needed(n, m, percent)) for m in partners(n, percent) if m and min(n, m) <= bound]


def boundary(sizes: dict[int, int], percent: int = 80, list_cost: float = 4.0) -> int:
    """The L of least cost.  Cost of a light set: its subsets.  Cost of a heavy set: its
    prefix entries, each with a candidate that is counted in time of its size."""
    best = (float("inf"), 0)
    for bound in range(MOST_LIGHT + 1):
        cost = 0.0
        for n, rows in sizes.items():
            if n <= 2 * MOST_LIGHT:
                cost += rows * sum(comb(n, c) for _, _, c in light_keys(n, bound, percent))
            if n > bound:
                cost += rows * prefix(n, percent)[0] * (1 + list_cost * 2 * n / 100)
        best = min(best, (cost, bound))
    return best[1]


def _summary(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, text_no, n, node) and of shingles that a run of documents has often (node, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        texts = total = 0

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            ok = counts >= max(3, FREQUENT * texts)
            values, counts = values[ok].view(np.int64), counts[ok]
            return pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.int64()), pa.array(counts, pa.int64()), pa.array(values), pa.array(np.ones(len(values), np.int32))], names=["doc_id", "text_no", "n", "node", "kind"])

        for batch in batches:
            n, node = [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                held.append(s)
                texts += 1
                total += len(s)
                if total >= COUNTED:
                    yield frequent()
                    held, texts, total = [], 0, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.zeros(len(n), np.int32))], names=["doc_id", "text_no", "n", "node", "kind"])
        if held:
            yield frequent()

    return docs.mapInArrow(trimmed(run), "doc_id long, text_no long, n long, node long, kind int")


def _send(bound: int, frequent, percent: int):
    """Entries of a batch: subsets of light pairs, prefixes of sets that can be heavy."""

    def entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        often, seen, out, total = frequent.value, set(), [], 0
        for s in shingle_sets(batch.column(0)):
            n = len(s)
            if not n:
                continue
            node = xxhash.xxh3_64_intdigest(s.tobytes())
            if node in seen:
                continue
            seen.add(node)
            keys, flags = [], []
            for small, large, c in light_keys(n, bound, percent) if n <= bound * 100 // percent else []:
                subsets = np.array(list(combinations(s.tolist(), c)), np.uint64)
                h = np.full(len(subsets), small * 1000 + large, np.uint64)
                for column in subsets.T:
                    h = mix(h * np.uint64(0x9FB21C651E98DF25) + column)
                keys.append(h)
                flags.append(np.full(len(h), LIGHT, np.int32))
            if n > bound:
                probe, index = prefix(n, percent)
                f = np.full(probe, PROBED, np.int32)
                f[:index] = INDEXED
                if len(often):
                    hot = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    order = np.argsort(hot, kind="stable")
                    s = s[order]
                    f[hot[order[:probe]]] += HOT
                keys.append(s[:probe])
                flags.append(f)
            e = np.empty(sum(map(len, keys)), ENTRY)
            e["key"], e["flag"] = np.concatenate(keys), np.concatenate(flags)
            e["node"], e["size"] = np.uint64(node).astype(np.int64), n
            out.append(e)
            total += len(e)
            if total > 200_000:
                yield np.concatenate(out)
                out, total = [], 0
        if out:
            yield np.concatenate(out)

    return entries


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link all documents whose sets of 5-word shingles have a Jaccard similarity of at least percent / 100.

    Returns per row doc_id, text_no (xxhash64 of the text, as rows may share an id), n_shingles and component_id
    (smallest doc_id that links reach, itself included).  Texts with fewer than five words have one
    shingle; null, empty and blank texts have none and link with nothing.  Equal
    sets are one node, so copies aren't compared; a set is known by the 64-bit
    hash of its 64-bit shingle hashes.  Rows with a null id take no part in
    links and have a null component; rows that repeat an id are rows of their
    own; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_no", F.xxhash64("text"))
    summary = written(_summary(texts), "shingled")
    rows = summary.filter("kind = 0").select("doc_id", "text_no", F.col("n").alias("n_shingles"), "node")
    linking = rows.filter("doc_id is not null and n_shingles > 0")
    total = rows.count()
    often = [r[0] for r in summary.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(3.0, FREQUENT * total)).select("node").collect()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(often, np.int64).view(np.uint64)))
    sizes = {r[0]: r[1] for r in linking.filter(F.col("n_shingles") <= 2 * MOST_LIGHT).groupBy("n_shingles").count().collect()}
    bound = boundary(sizes, percent)
    found = exchange(texts.filter("doc_id is not null").select("text"), _send(bound, frequent, percent), receive(percent), FOUND, hot=HOT)
    found = written(found, "candidates")
    nodes = linking.groupBy("node").agg(F.min("doc_id").alias("first_id"))

    def sets_of(asked: DataFrame) -> DataFrame:
        asked = written(asked.join(nodes, "node").select(F.col("first_id").alias("doc_id")), "asked")
        wanted = key_filter(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(may_have(wanted.value, batch.column(0).to_numpy())))
                packed = [s.tobytes() for s in shingle_sets(batch.column(1))]
                node = np.array([xxhash.xxh3_64_intdigest(p) for p in packed], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(packed, pa.binary())], names=["doc_id", "node", "s"])

        packed = texts.filter("doc_id is not null").mapInArrow(trimmed(run), "doc_id long, node long, s binary")
        return written(packed.join(asked.hint("shuffle_hash"), "doc_id", "left_semi").select("node", "s"), "sets")

    parts_ = linked_components(found, sets_of, percent)
    named = nodes.join(parts_, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component_id")
    out = rows.join(named, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_no", "n_shingles", own.alias("component_id"))
