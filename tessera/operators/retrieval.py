"""Keyword and vector retrieval, rank fusion, and seats for counter-evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import levels as L
from tessera.sources import shared


def ranked(df: DataFrame, by: str, score: Column, *ties: str) -> DataFrame:
    """rank (from 1) within each ``by``, best score first; ids decide ties."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(score, *ties)))


#: Rows of a block, and the most cells that blocks are cut from.
BLOCK, CELLS = 4_096, 256
#: Queries that a block of vectors meets at a time, and those of one product.
ASKED, TILE = 16_384, 512
#: Cosines are ranked by nine decimals; bounds leave room for that and for roundings.
MARGIN = 1e-8
UNITS = "id long, dim int, u binary, within string, target string"
NAMES = ["id", "dim", "u", "within", "target"]


def _units(rows: DataFrame, id_col: str) -> DataFrame:
    """Vectors scaled to length 1, packed; rows without an id, null, empty and zero vectors and those with a null or non-finite component are left out.

    within and target (see ``first_close``) are null where there are no such columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            ids, dims, packed = [], [], []
            for i, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                u = values[a:b] / np.abs(values[a:b]).max()  # squares can't overflow
                ids.append(i)
                dims.append(b - a)
                packed.append((u / np.sqrt((u * u).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary()), batch.column(2), batch.column(3)], names=NAMES)

    said = (F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("within", "target"))
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), *said)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    return v.filter(usable).mapInArrow(run, UNITS)


def _vectors(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["u"].to_pylist()), np.float64).reshape(len(table), -1)


def _ball(table: pa.Table) -> pa.Table:
    """Centre, radius and size of a block."""
    u = _vectors(table)
    centre = u.mean(axis=0)
    radius = np.sqrt(((u - centre) ** 2).sum(axis=1).max())
    return pa.table({"dim": table["dim"][:1].combine_chunks(), "block": table["block"][:1].combine_chunks(), "centre": pa.array([centre.tolist()]), "radius": pa.array([float(radius)]), "n": pa.array([len(u)], pa.int64())})


def _dealt(units: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows with ``block``: near ones share a cell (that of the nearest pivot), and cells are cut by counts, so that no block holds much more than BLOCK rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(1).to_numpy(), np.zeros(len(batch), np.int32)
            for d in np.unique(dims).tolist():
                if d in pivots:
                    at = np.flatnonzero(dims == d)
                    cell[at] = (_vectors(pa.table({"u": batch.column(2).take(pa.array(at))})) @ pivots[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*NAMES, "cell"])

    cells = shared.written(units.mapInArrow(run, UNITS + ", cell int"), "cells")
    sizes = shared.written(cells.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("id", "u"), "parts")
    return shared.written(cells.join(sizes, ["dim", "cell"]).select(*NAMES, (F.shiftleft(F.col("cell").cast("long"), 32) + part).alias("block")), "blocks")


def _meetings(vectors: DataFrame, queries: DataFrame, keep: Callable[[DataFrame], DataFrame], pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], asked: int = ASKED) -> DataFrame:
    """query_id, doc_id and cosine of what ``pick`` takes from the products of the pairs of blocks that ``keep`` leaves.

    Both sides are dealt into blocks, of which centre and radius are known.  Pairs of blocks come with ``most`` and ``least``, between which all
    their cosines are (triangle inequality of the distances of unit vectors); pairs that ``keep`` leaves out never meet.  A block of vectors meets its
    blocks of queries together, about ``asked`` queries at a time, so it is sent once for these and not once for each block."""
    v, q = shared.written(_units(vectors, "doc_id"), "vectors"), shared.written(_units(queries, "query_id"), "queries")
    n = v.count()
    sample = v.orderBy(F.xxhash64("u"), "id").limit(min(CELLS, max(1, n // BLOCK * 4))).collect()  # CELLS vectors at most
    pivots = {d: np.stack([np.frombuffer(r.u) for r in sample if r.dim == d]) for d in {r.dim for r in sample}}
    v, q = _dealt(v, pivots), _dealt(q, pivots)
    ball = "dim int, block long, centre array<double>, radius double, n long"
    balls = [shared.written(side.groupBy("dim", "block").applyInArrow(_ball, ball), "balls").toDF("dim", *(f"{name}_{c}" for c in ("block", "centre", "radius", "n"))) for side, name in ((v, "v"), (q, "q"))]
    # a row stands for thousands of vectors: pairs of these are few beside the products that follow
    pairs = balls[0].join(balls[1], "dim")
    between = F.sqrt(F.aggregate(F.zip_with("v_centre", "q_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near, far = F.greatest(between - F.col("v_radius") - F.col("q_radius"), F.lit(0.0)), between + F.col("v_radius") + F.col("q_radius")
    pairs = pairs.select("dim", "v_block", "q_block", "v_n", "q_n", (1 - near * near / 2).alias("most"), (1 - far * far / 2).alias("least"))
    pairs = shared.written(keep(pairs).select("dim", "v_block", "q_block", "q_n"), "pairs")
    before = Window.partitionBy("dim", "v_block").orderBy("q_block").rowsBetween(Window.unboundedPreceding, -1)
    turns = pairs.withColumn("turn", F.floor(F.coalesce(F.sum("q_n").over(before), F.lit(0)) / asked))
    v = v.join(turns.select("dim", "v_block", "turn").distinct().withColumnRenamed("v_block", "block"), ["dim", "block"]).withColumnRenamed("block", "v_block")
    q = q.join(turns.withColumnRenamed("q_block", "block"), ["dim", "block"])
    sides = [side.select("v_block", "turn", *NAMES, F.lit(asks).alias("asks")) for side, asks in ((v, False), (q, True))]
    keyed = "within" in queries.columns

    def product(table: pa.Table) -> pa.Table:
        asks, ids, u = table["asks"].to_numpy(), table["id"].to_numpy(), _vectors(table)
        within, target = (pc.fill_null(table[c].combine_chunks().dictionary_encode().indices, -1).to_numpy() for c in ("within", "target"))
        docs, asked, of, wanted = ids[~asks], ids[asks], within[asks], target[asks]
        found, vectors = [], u[~asks]
        for at in range(0, len(asked), TILE):
            tile = slice(at, at + TILE)
            cosine = vectors @ u[asks][tile].T
            if keyed:
                cosine[(within[~asks][:, None] != of[tile]) | ((wanted[tile] >= 0) & (target[~asks][:, None] != wanted[tile]))] = -np.inf
            row, column = pick(docs, cosine)
            found.append(pa.table({"query_id": pa.array(asked[tile][column]), "doc_id": pa.array(docs[row]), "cosine": pa.array(cosine[row, column])}))
        return pa.concat_tables(found) if found else pa.table({"query_id": ids[:0], "doc_id": ids[:0], "cosine": np.zeros(0)})

    return sides[0].unionByName(sides[1]).groupBy("dim", "v_block", "turn").applyInArrow(product, "query_id long, doc_id long, cosine double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, cosine and rank of the k nearest vectors of each query; ids decide ties of nine decimals.

    Queries with equal vectors are asked once.  A block of queries meets the blocks that may hold one of its k nearest: those as near as the k vectors that are certainly not farther.
    Each pair of blocks keeps its k best of every query.  Rows that ``_units`` leaves out take no part, and vectors of different length don't meet."""

    def best(ids: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = np.round(cosine, 9)
        rows, columns = [], []
        for j in range(value.shape[1]):
            v = value[:, j]
            some = np.flatnonzero(v >= np.partition(v, len(v) - k)[len(v) - k]) if len(v) > k else np.arange(len(v))
            rows.append(some[np.lexsort((ids[some], -v[some]))[:k]])
            columns.append(np.full(len(rows[-1]), j))
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *columns])

    def near_enough(pairs: DataFrame) -> DataFrame:
        surest = Window.partitionBy("dim", "q_block").orderBy(F.desc("least"), "v_block").rowsBetween(Window.unboundedPreceding, 0)
        have = pairs.withColumn("have", F.sum("v_n").over(surest))
        bound = have.filter(F.col("have") >= k).groupBy("dim", "q_block").agg(F.max("least").alias("bound"))
        return pairs.join(bound, ["dim", "q_block"], "left").filter(F.col("bound").isNull() | (F.col("most") >= F.col("bound") - MARGIN))

    def first(rows: DataFrame) -> DataFrame:
        return ranked(rows, "query_id", F.desc(F.round("cosine", 9)), "doc_id").filter(F.col("rank") <= k)

    asked = shared.written(queries.filter("query_id is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null"), "asked")
    once = shared.written(asked.select("embedding").distinct().select(F.monotonically_increasing_id().alias("once"), "embedding"), "once")
    rows = first(_meetings(vectors, once.withColumnRenamed("once", "query_id"), near_enough, best)).drop("rank").withColumnRenamed("query_id", "once")
    # ranked again, as an id may have several vectors
    return first(rows.join(asked.join(once, "embedding").select("query_id", "once"), "once").select(F.col("query_id").cast("long").alias("query_id"), "doc_id", "cosine"))


def close_pairs(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """query_id, doc_id and cosine of the pairs with a cosine of at least ``least``; blocks too far apart for one don't meet."""
    return _meetings(vectors, queries, lambda pairs: pairs.filter(F.col("most") >= least - MARGIN), lambda ids, cosine: np.nonzero(cosine >= least))


def first_close(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """query_id and the smallest doc_id with a cosine of at least ``least`` and the query's ``within``, and its ``target`` where the query has one; queries without any are left out.

    A pair of blocks hands on one row a query, however many vectors are close to it."""

    def smallest(ids: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        close = cosine[order] >= least
        columns = np.flatnonzero(close.any(axis=0))
        return order[close[:, columns].argmax(axis=0)], columns

    found = _meetings(vectors, queries, lambda pairs: pairs.filter(F.col("most") >= least - MARGIN), smallest)
    return found.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))


def fuse(rankings: DataFrame, k: int = L.RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of rows (query_id, doc_id, rank, share)."""
    return rankings.groupBy("query_id", "doc_id").agg(F.sum(F.col("share") / (k + F.col("rank"))).alias("fused"), F.max("semantic").alias("semantic"))


def minmax(df: DataFrame, by: str, value: str) -> Column:
    """Value scaled to 0.05..1 within each group; 1 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise(L.MINMAX_FLOOR + (1 - L.MINMAX_FLOOR) * (F.col(value) - low) / (high - low))


def counter_seats(hits: DataFrame, k: int, seats: int = L.CONTRA_SEATS) -> DataFrame:
    """The first k hits of each query, with semantic counter-evidence seated if too little is there.

    hits: query_id, claim_id, score, contra, semantic.  The best semantic
    contradicting hits from beyond k replace the lowest others."""
    all_ = Window.partitionBy("query_id").orderBy(F.desc("score"), "claim_id")
    r = hits.withColumn("r", F.row_number().over(all_))
    head = F.col("r") <= k
    per = Window.partitionBy("query_id")
    can = ~head & F.col("contra") & F.col("semantic")
    r = r.withColumn("have", F.sum((head & F.col("contra")).cast("int")).over(per)).withColumn("spare", F.sum((head & ~F.col("contra")).cast("int")).over(per))
    r = r.withColumn("able", F.sum(can.cast("int")).over(per)).withColumn("t", F.sum(can.cast("int")).over(all_.rowsBetween(Window.unboundedPreceding, 0)))
    up = Window.partitionBy("query_id").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("last", F.sum((head & ~F.col("contra")).cast("int")).over(up))
    m = F.least(F.greatest(F.lit(0), F.lit(seats) - F.col("have")), F.col("able"), F.col("spare"))
    keep = (head & (F.col("contra") | (F.col("last") > m))) | (can & (F.col("t") <= m))
    return r.filter(keep).select("query_id", "claim_id", "score", "contra", (~head).alias("seated"))
