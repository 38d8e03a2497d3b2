"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import trimmed, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: each node with the smallest that it reaches by them."""
    held = list(batches)
    u = np.concatenate([b.column(0).to_numpy() for b in held]) if held else np.zeros(0, np.int64)
    v = np.concatenate([b.column(1).to_numpy() for b in held]) if held else np.zeros(0, np.int64)
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    parent = list(range(len(names)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.array(parent, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    child = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[root[child]])], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: connect each node's larger (large) or smaller neighbours to its smallest."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = both.join(low, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether the links (u, v), v < u, are stars: each u has one v, and no v is a u.

    Links of a component always connect all of it, so each star then is a whole one around its smallest node."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    held = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.filter("up > 1 or (up > 0 and down > 0)").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node and component (its smallest node) of every node that has a link.

    ``edges`` has one row per link in either direction; self links and repeats
    change nothing.  Each partition first makes stars of its own links.  Every round is written to the shared folder; a node with
    very many links is summed up before its links are joined, and the join of a
    very large node can be split because it needs no grouping behind it."""
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e.mapInArrow(trimmed(_forest), "u long, v long"), "links")

    while not _settled(e):
        e = written(_star(_star(e, True), False), "links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
