"""Near-duplicate vectors by int8 tile products with per-vector error bounds.

A unit vector u is held as q / s with int8 components; e bounds |u - q/s|.  Then
|<u,v> - <q_u,q_v>/(s_u s_v)| <= e_u |v| + |q_u/s_u| e_v, so only pairs whose
approximate product plus this bound reaches the threshold, and minus this bound doesn't,
are computed in double precision.  Products of int8 values are summed exactly in float32 matrix
multiplication, which holds integers below 2**24.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import flat
from tessera.llm.components import components
from tessera.llm.runtime import small_batches, trim, trimmed, written

#: Vectors of a block; a task compares two blocks of one label.
BLOCK = 4096
#: Vectors of a tile, the unit of one matrix product.
TILE = 512
#: Dimensions up to which sums of products stay exact in float32.
MAX_DIM = (1 << 24) // (127 * 127)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; they are scaled by their largest component first, against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, the factors that scale them back, and bounds of the errors."""
    factor = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / factor[:, None]).astype(np.int8)
    error = np.sqrt(((u - q * factor[:, None]) ** 2).sum(axis=1))
    return q, factor, error * (1 + 1e-9) + 1e-12


def judged(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of two tiles (int8, factors, errors) which pairs certainly reach the threshold, and which may or may not."""
    qa, fa, ea = a
    qb, fb, eb = b
    if qa.shape[1] <= MAX_DIM:
        near = (qa.astype(np.float32) @ qb.astype(np.float32).T).astype(np.float64)
    else:
        near = qa.astype(np.float64) @ qb.astype(np.float64).T
    near *= fa[:, None]
    near *= fb[None, :]
    bound = ea[:, None] + (1 + ea[:, None]) * eb[None, :] + 1e-9
    sure = near - bound >= threshold
    return sure, (near + bound >= threshold) & ~sure


def hooked(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of ``root`` (parents, smaller or equal) along the links i, j."""
    while len(i):
        x, y = root[i], root[j]
        low = np.minimum(x, y)
        some = x != y
        if not some.any():
            return
        i, j, low, high = i[some], j[some], low[some], np.maximum(x, y)[some]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _one_by_one(v: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Unit vectors, int8 components, factors and errors of a list column, row by row: a row gives the same bits in any company."""
    bounds, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    units = [unit(values[None, a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    each = [quantised(u) for u in units]
    return [u[0] for u in units], [q[0] for q, _, _ in each], np.array([f[0] for _, f, _ in each]), np.array([e[0] for _, _, e in each])


SCHEMA = "kind string, cls long, other long, n long, lo int, hi int"
COUNT, LINK, ASK = "count", "link", "ask"


def _rows(kind: str, cls: np.ndarray, other: np.ndarray, n: np.ndarray, lo: int, hi: int) -> pa.Table:
    k = len(cls)
    arrays = [pa.array([kind] * k, pa.string()), *(pa.array(np.broadcast_to(np.asarray(x, np.int64), k)) for x in (cls, other, n)), pa.array(np.full(k, lo, np.int32)), pa.array(np.full(k, hi, np.int32))]
    return pa.Table.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")])


def _block(threshold: float, full: bool):
    """What the vectors of two blocks tell: numbers of linked rows, links that connect what is connected, and vectors that must be compared in
    full precision.  With ``full`` these come (as v) and only the pairs that int8 leaves open are compared."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, n, own = (table[c].to_numpy() for c in ("cls", "n", "b"))
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        if full:
            u, q, factor, error = _one_by_one(table["v"].combine_chunks())
            u, q = np.stack(u), np.stack(q)
        else:
            q = np.frombuffer(flat(table["q"])[0], np.int8).reshape(len(cls), -1)
            factor, error = table["factor"].to_numpy(), table["error"].to_numpy()
        one = lo == hi
        left, right = (np.arange(len(cls)),) * 2 if one else (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
        links, root, ask = np.zeros(len(cls), np.int64), np.arange(len(cls)), np.zeros(len(cls), bool)
        for x in range(0, len(left), TILE):
            a = left[x : x + TILE]
            for y in range(x if one else 0, len(right), TILE):
                b = right[y : y + TILE]
                sure, open_ = judged((q[a], factor[a], error[a]), (q[b], factor[b], error[b]), threshold)
                if one and x == y:
                    sure, open_ = np.triu(sure, 1), np.triu(open_, 1)
                i, j = np.nonzero(open_)
                if full:
                    ok = np.einsum("ij,ij->i", u[a[i]], u[b[j]]) >= threshold
                    hit = np.zeros(open_.shape, bool)
                    hit[i[ok], j[ok]] = True
                else:
                    hit = sure
                    ask[a[open_.any(1)]] = True
                    ask[b[open_.any(0)]] = True
                links[a] += hit @ n[b]
                links[b] += n[a] @ hit
                i, j = np.nonzero(hit)
                hooked(root, a[i], b[j])
        some, child, asked = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(cls))), np.flatnonzero(ask)
        return pa.concat_tables([_rows(COUNT, cls[some], 0, links[some], lo, hi), _rows(LINK, cls[child], cls[root[child]], 0, lo, hi), _rows(ASK, cls[asked], own[asked], 0, lo, hi)])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link all vectors of one label (not null) whose cosine is at least the threshold.

    Returns per row: vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable by links, itself included) and kept (vec_id =
    component_id).  Null, zero and empty vectors and those with null or
    non-finite components link with nothing, nor do rows with a null label or id
    or vectors of different dimension.  Equal vectors of a label are a class that is
    compared once, with its number of rows; rows that repeat an id are rows of their
    own, and those with equal vectors and labels are copies.  Other columns are ignored; an empty table gives no rows.

    Tasks get int8 vectors of two blocks of a label, which settle most pairs; of the vectors
    of pairs within the error bounds the double ones are sent for a second look.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + 0.0)))  # -0.0 becomes 0.0
    rows = written(rows.withColumn("usable", F.col("v").isNotNull()), "vectors")
    classes = rows.filter("usable").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, q, factor, error = _one_by_one(batch.column(1))
            arrays = [batch.column(0), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(factor, pa.float64()), pa.array(error, pa.float64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["cls", "q", "factor", "error", "label", "dim", "n"])

    kind = rows.schema["label"].dataType.simpleString()
    held = classes.select("cls", "v", "label", "dim", "n").mapInArrow(trimmed(quantise), f"cls long, q binary, factor double, error double, label {kind}, dim int, n long")
    blocks = classes.groupBy("label", "dim").count().select("label", "dim", F.ceil(F.col("count") / BLOCK).cast("int").alias("g"))
    dealt = held.join(blocks, ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("cls"), F.col("g").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("lo", F.least("b", "other")).withColumn("hi", F.greatest("b", "other"))
    tiles = dealt.groupBy("label", "dim", "lo", "hi")
    first = written(tiles.applyInArrow(_trimmed_table(_block(threshold, False)), SCHEMA), "compared")
    asked = first.filter(F.col("kind") == ASK).select("cls", F.col("other").cast("int").alias("b"), "lo", "hi").join(classes.select("cls", "label", "dim", "n", "v"), "cls")
    second = written(asked.groupBy("label", "dim", "lo", "hi").applyInArrow(_trimmed_table(_block(threshold, True)), SCHEMA), "compared")
    found = first.unionByName(second)
    counts = found.filter(F.col("kind") == COUNT).groupBy("cls").agg(F.sum("n").alias("linked"))
    linked_to = components(found.filter(F.col("kind") == LINK), "cls", "other").select(F.col("node").alias("cls"), "component")
    reps = classes.join(counts, "cls", "left").join(linked_to, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    reps = reps.join(smallest, "component").select("label", "v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(reps, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _trimmed_table(f):
    """An applyInArrow function that gives memory back."""

    def call(table: pa.Table) -> pa.Table:
        out = f(table)
        trim()
        return out

    return call
