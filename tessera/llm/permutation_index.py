"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of distance: near vectors see the pivots in similar orders.  Rows are
dealt to segments; a segment has an inverted file, which lists under each pivot the rows that have it among their nearest,
with its place there.  A query runs through the files of its own pivots and adds up, row by row, how much the
places agree, which ranks the rows by the footrule distance of the two orders (a pivot that is absent counts as
one place behind the last).  Rows are then compared with the query in that order, in double precision: a twentieth of the segment
first, then twice as many, until the best found all come from the first half of what has been compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow_text import flat
from tessera.llm.runtime import small_batches, trim, trimmed, written

#: Pivots of each dimension (a sample of bounded size, those of least hash), and how many of the nearest make a permutation.
PIVOTS, PREFIX = 256, 64
#: Rows of a segment and queries of a block, which meet in one task.
SEGMENT, QUERIES = 8192, 4096
#: Share of a segment that is compared first, and rows that are in any case.
SHARE, LEAST = 0.05, 200

ENCODED = "row long, vec_id long, dim int, v binary, seen binary"


class Index(NamedTuple):
    """Encoded rows (written), the pivots of each dimension, numpy's type of the components, and the length of a permutation."""

    rows: DataFrame
    pivots: dict[int, np.ndarray]
    kind: str
    prefix: int


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """For each row its nearest pivots in order of distance; pivots at one distance in their own order."""
    large = np.abs(pivots).max() or 1.0
    p, x = pivots / large, x / large
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1.0)  # no product can overflow
    distance = (p * p).sum(axis=1)[None, :] / scale - 2 * (x / scale) @ p.T
    return np.argsort(distance, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows from a query, also where squares leave the range of doubles."""
    d = x - q
    out = np.sqrt(np.einsum("ij,ij->i", d, d))
    odd = ~np.isfinite(out) | (out < 1e-150)
    if odd.any():
        top = np.abs(d[odd]).max(axis=1, initial=0.0)
        some = np.where(top > 0, top, 1.0)
        with np.errstate(over="ignore"):
            out[odd] = top * np.sqrt(((d[odd] / some[:, None]) ** 2).sum(axis=1))
    return out


class Segment:
    """Rows in order of their ids with their inverted file."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seen: np.ndarray, pivots: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.prefix = ids[order], x[order], seen.shape[1]
        posts = seen[order].reshape(-1)
        by = np.argsort(posts, kind="stable")
        self.at = np.searchsorted(posts[by], np.arange(pivots + 1))
        self.row, self.place = by // max(1, self.prefix), by % max(1, self.prefix)

    def agreement(self, seen: np.ndarray) -> np.ndarray:
        """How much less than the largest footrule distance each row has, halved."""
        out = np.zeros(len(self.ids), np.int64)
        for place, pivot in enumerate(seen.tolist()):
            a, b = self.at[pivot], self.at[pivot + 1]
            out[self.row[a:b]] += self.prefix - np.maximum(self.place[a:b], place)
        return out

    def nearest(self, own: int, q: np.ndarray, seen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, ties to smaller ids; rows with the query's id are left out."""
        n = len(self.ids)
        agree = self.agreement(seen)
        ranked = np.sort(agree)[::-1]
        size, got, far = max(LEAST, int(n * SHARE)), np.zeros(0, np.int64), np.zeros(0)
        above = ranked[0] + 1
        while True:
            size = min(size, n)
            level = ranked[size - 1]  # all rows that agree as much as the last one are compared too
            more = np.flatnonzero((agree >= level) & (agree < above) & (self.ids != own))
            got, far = np.concatenate((got, more)), np.concatenate((far, distances(self.x[more], q)))
            best = np.lexsort((got, far))[:k]
            got, far = got[best], far[best]
            if level == ranked[-1] or (len(got) == k and (agree[got] >= ranked[size // 2]).all()):
                return self.ids[got], far
            above, size = level, 2 * size


FOUND = "query long, query_id long, found array<struct<vec_id: long, score: double>>"


def _search(pivots: dict[int, int], kind: str, k: int):
    """What the queries of a block find in a segment."""

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        x = np.frombuffer(flat(table["v"])[0], kind).reshape(len(table), dim).astype(np.float64)
        seen = np.frombuffer(flat(table["seen"])[0], np.int16).reshape(len(table), -1)
        ids, row, asks = table["vec_id"].to_numpy(), table["row"].to_numpy(), table["asks"].to_numpy()
        segment = Segment(ids[~asks], x[~asks], seen[~asks], pivots[dim])
        which, near, far = np.flatnonzero(asks), [], []
        for j in which.tolist() if len(segment.ids) else []:
            found, score = segment.nearest(int(ids[j]), x[j], seen[j], k)
            near.append(found)
            far.append(score)
        which = which[: len(near)]
        ends = np.cumsum([0, *map(len, near)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *near])), pa.array(np.concatenate([np.zeros(0), *far]))], names=["vec_id", "score"])
        out = pa.table({"query": pa.array(row[which]), "query_id": pa.array(ids[which]), "found": pa.ListArray.from_arrays(pa.array(ends), pairs)})
        del x, seen, segment
        trim()
        return out

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _encoded(rows: DataFrame, pivots: dict[int, np.ndarray], kind: str, prefix: int) -> DataFrame:
    """Rows whose dimension has pivots, with their permutations."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, row, ids = batch.column(2).to_numpy(), batch.column(3), batch.column(0)
            for d in np.unique(dims).tolist():
                if d in pivots:
                    at = pa.array(np.flatnonzero(dims == d))
                    x = batch.column(1).take(at).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                    seen = permutations(x.astype(np.float64), pivots[d], prefix)
                    arrays = [row.take(at), ids.take(at), pa.array(np.full(len(at), d, np.int32)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([s.tobytes() for s in seen], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "dim", "v", "seen"])

    return rows.withColumn("row", F.monotonically_increasing_id()).select("vec_id", "v", "dim", "row").mapInArrow(trimmed(encode), ENCODED)


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX) -> Index:
    """Index every usable row: those with an id and a vector that is neither null nor zero nor has null or non-finite components.

    Pivots are the different vectors of least hash, at most ``pivots`` of each dimension; nothing else is gathered by the driver."""
    small_batches(vectors.sparkSession)
    rows = _usable(vectors, id_col, vector_col).withColumn("h", F.xxhash64("v"))
    few = rows.select("dim", "h").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy("h"))).filter(F.col("nth") <= pivots).select("dim", "h")
    few = written(few, "pivots")
    chosen = rows.join(F.broadcast(few), ["dim", "h"]).groupBy("dim", "h").agg(F.first("v").alias("v")).orderBy("dim", "h")
    held: dict[int, list] = {}
    for r in chosen.toLocalIterator():
        held.setdefault(r.dim, []).append(r.v)
    kind = "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    arrays = {d: np.array(v, np.float64) for d, v in held.items()}
    return Index(written(_encoded(rows.drop("h"), arrays, kind, prefix), "permutations"), arrays, kind, prefix)


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest indexed rows found for each query row: query_id, rank (from 1), vec_id, score (the distance), ties to the smaller vec_id.

    Queries are rows that could be indexed; others, and those of a dimension that has no indexed row, find nothing.  Rows with
    the query's own id are not among its neighbours; indexed rows that repeat an id are rows of their own, and so are queries
    that do.  Equal vectors have equal permutations and are compared together, however many there are.  Fewer than k rows
    give all of them, an empty table gives none.  Every segment meets every block of queries once; of each only the k best go on."""
    spark = queries.sparkSession
    small_batches(spark)
    asked = _usable(queries, id_col, vector_col).withColumn("v", F.col("v").cast("array<float>" if index.kind == "<f4" else "array<double>"))
    asked = written(_encoded(asked, index.pivots, index.kind, index.prefix), "queries")
    sizes = index.rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SEGMENT).cast("int").alias("segments"))
    sizes = sizes.join(asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks")), "dim")
    sizes = written(sizes, "index-sizes")

    def dealt(rows: DataFrame, own: str, other: str, n_own: str, n_other: str, asks: bool) -> DataFrame:
        out = rows.join(sizes, "dim").withColumn(own, F.pmod(F.xxhash64("row"), F.col(n_own).cast("long")).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).select("dim", "segment", "block", "row", "vec_id", "v", "seen", F.lit(asks).alias("asks"))

    met = dealt(index.rows, "segment", "block", "segments", "blocks", False).unionByName(dealt(asked, "block", "segment", "blocks", "segments", True))
    counts = {d: len(p) for d, p in index.pivots.items()}
    found = met.groupBy("dim", "segment", "block").applyInArrow(_search(counts, index.kind, k), FOUND)
    each = found.select("query", "query_id", F.inline("found"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
