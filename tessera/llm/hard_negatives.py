"""Hard negatives by dual-tree search over integer vectors.

Anchors and candidates are each held in a tree of balls.  The inner product of any anchor in ball a with any candidate in
ball c lies within <ca, cc> ± (ra |cc| + rc |ca| + ra rc).  An anchor group needs a candidate node only if this interval
reaches the least score that one of its searches can still use and does not lie above the largest; else the node is
passed over for the whole group at once.  Pairs of leaves are scored exactly, and what they find raises the least useful
score of the leaf and of the groups around it.

Rows are dealt to segments and anchors to blocks, which meet once; each meeting is a search of its own and gives
the best of each search, of which the best are taken.  Positives meet within a label only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow_text import flat
from tessera.llm.runtime import small_batches, trim, trimmed, written

#: Rows of a segment and anchors of a block.
SEGMENT, ANCHORS = 8192, 2048
#: Rows of a leaf of candidates and of anchors.
LEAF, ANCHOR_LEAF = 512, 64
#: Integers below this are exact as doubles, and sums of products in longs.
EXACT, WIDE = 1 << 53, 1 << 62


class Tree:
    """Balls around rows; ``order`` has the rows leaf by leaf.

    A node's rows are laid along the line through two far ones and cut where the two sides differ most (the largest variance
    between them), with a 32nd of them on each side at least."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(x))
        self.bounds: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres, self.radius = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node, rows = len(self.bounds), x[self.order[a:b]].astype(np.float64)
            centre = rows.mean(axis=0)
            self.bounds.append((a, b))
            self.children.append(None)
            centres.append(centre)
            # roundings of the centre are no matter: the radius is measured from what is held
            self.radius.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())))
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            if b - a > leaf:
                one = rows[int(((rows - centre) ** 2).sum(axis=1).argmax())]
                other = rows[int(((rows - one) ** 2).sum(axis=1).argmax())]
                along = (rows - centre) @ (one - other)
                by = np.argsort(along, kind="stable")
                first = np.arange(max(1, (b - a) // 32), b - a - (b - a) // 32)
                cut = a + int(first[np.argmax(along[by].cumsum()[first - 1] ** 2 / (first * (b - a - first)))])
                self.order[a:b] = self.order[a:b][by]
                todo += [(a, cut, node, 0), (cut, b, node, 1)]
        self.centre = np.stack(centres)
        self.length = np.sqrt((self.centre**2).sum(axis=1))


def best(anchors: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, usable: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each search (anchor, lo, hi) the k rows with the highest inner products within lo and hi, ties to earlier rows.

    ``lo`` and ``hi`` are [anchor, search]; ``usable`` tells which pairs of given anchors and rows may be found.
    Returns numbers of rows and scores as [anchor, search, k], and which of them are there."""
    n, searches = lo.shape
    if not n or not len(rows):
        return np.zeros((n, searches, k), np.int64), np.zeros((n, searches, k), np.int64), np.zeros((n, searches, k), bool)
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    kind = np.float64 if most < EXACT else np.int64
    whole = np.int64 if (most + 1) * (len(rows) + 1) < WIDE else object  # of a score and a row's number as one integer
    width, none = len(rows) + 1, -(most + 1) * (len(rows) + 1) - 1
    a, c = Tree(anchors, ANCHOR_LEAF), Tree(rows, LEAF)
    left, right = anchors[a.order].astype(kind), rows[c.order].astype(kind)
    keys = np.full((n, searches, k), none, whole)
    least, top = np.where(lo > hi, WIDE, lo), np.where(lo > hi, -WIDE, hi)  # a search with an empty range needs nothing
    need, reach = [float(least[a.order[x:y]].min()) for x, y in a.bounds], [float(top[a.order[x:y]].max()) for x, y in a.bounds]

    def interval(i: int, j: int) -> tuple[float, float]:
        middle = float(a.centre[i] @ c.centre[j])
        spread = a.radius[i] * c.length[j] + c.radius[j] * a.length[i] + a.radius[i] * c.radius[j]
        spread += 1e-9 * (spread + a.length[i] * c.length[j]) + 1e-9
        return middle - spread, middle + spread

    def score(i: int, j: int) -> None:
        (x, y), (u, v) = a.bounds[i], c.bounds[j]
        mine, theirs = a.order[x:y], c.order[u:v]
        s = (left[x:y] @ right[u:v].T).astype(np.int64)
        ok = usable(mine, theirs)
        key = s.astype(whole) * width + (width - 1 - theirs)
        for e in range(searches):
            some = ok & (s >= least[mine, e][:, None]) & (s <= top[mine, e][:, None])
            if some.any():
                both = np.concatenate((keys[mine, e], np.where(some, key, none)), axis=1)
                both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                keys[mine, e] = both
                low = both.min(axis=1)
                full = low > none
                at = mine[full]
                least[at, e] = np.maximum(least[at, e], (low[full] // width).astype(np.int64))
        need[i] = float(least[mine].min())

    def visit(i: int, j: int) -> None:
        low, high = interval(i, j)
        if high < need[i] or low > reach[i]:
            return
        mine, theirs = a.children[i], c.children[j]
        if mine is None and theirs is None:
            if first.get(i) != j:
                score(i, j)
        elif theirs is None or (mine is not None and a.radius[i] >= c.radius[j]):
            for x in mine:
                visit(x, j)
            need[i] = max(need[i], min(need[x] for x in mine))
        else:
            for x in sorted(theirs, key=lambda x: -interval(i, x)[1]):
                visit(i, x)

    first: dict[int, int] = {}  # each anchor leaf begins with the leaf whose interval reaches highest, so that its searches soon need little
    ends = [j for j, x in enumerate(c.children) if x is None]
    for i in (i for i, x in enumerate(a.children) if x is None):
        high = c.centre[ends] @ a.centre[i] + a.radius[i] * c.length[ends] + np.array(c.radius)[ends] * (a.length[i] + a.radius[i])
        first[i] = ends[int(high.argmax())]
        if need[i] < WIDE:
            score(i, first[i])
    for i in reversed(range(len(a.children))):  # children come behind their node
        if a.children[i] is not None:
            need[i] = min(need[x] for x in a.children[i])
    visit(0, 0)
    keys = -np.sort(-keys, axis=2)
    there = keys > none
    return (width - 1 - keys % width).astype(np.int64), (keys // width).astype(np.int64), there


PACKED = "row long, vec_id long, label long, dim int, v binary"
FOUND = "anchor long, anchor_id long, search int, found array<struct<vec_id: long, score: long>>"


def _packed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """Usable rows with their components as integers floor(scale * x), and a number of their own."""
    label = F.col(label_col) if vectors.schema[label_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", bad))
    rows = rows.filter(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x) * (scale * scale) < float(WIDE >> 2))
    rows = rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("q")).withColumn("row", F.monotonically_increasing_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(3)
            at, values = q.offsets.to_numpy(), q.values.to_numpy()
            binary = pa.array([values[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at), pa.int32()), binary], names=["row", "vec_id", "label", "dim", "v"])

    return rows.select("row", "vec_id", "label", "q").mapInArrow(trimmed(pack), PACKED)


def _met(rows: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Segments of rows and blocks of anchors of one group (``by``), each pair once, as rows with ``segment``, ``block`` and ``asks``.

    Groups are cut by counts, so one with a third of all rows is dealt like the others."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / SEGMENT).cast("int").alias("segments"))
    sizes = written(sizes.join(anchors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("blocks")), by), "meetings")

    def dealt(side: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        out = side.join(sizes, by).withColumn(own, F.pmod(F.xxhash64("row"), F.col(f"{own}s").cast("long")).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).withColumn("asks", F.lit(asks)).drop("segments", "blocks")

    return dealt(rows, "segment", "block", False).unionByName(dealt(anchors, "block", "segment", True), allowMissingColumns=True)


def _search(k: int, share: tuple[int, int] | None):
    """The k best rows of a segment for the anchors of a block: of the same label, or with ``share`` (least and most
    hundredths of each of the anchor's positive scores) of other labels."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        x = np.frombuffer(flat(table["v"])[0], np.int64).reshape(len(table), -1)
        ids, labels, number, asks = (table[c].to_numpy() for c in ("vec_id", "label", "row", "asks"))
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        if share is None:
            lo, hi = np.full((len(mine), 1), -WIDE), np.full((len(mine), 1), WIDE)
            usable = lambda i, j: (labels[mine[i]][:, None] == labels[theirs[j]][None, :]) & (ids[mine[i]][:, None] != ids[theirs[j]][None, :])
        else:
            scores = table["scores"].combine_chunks().take(pa.array(mine))
            held = np.diff(scores.offsets.to_numpy())
            lo, hi = np.full((len(mine), held.max(initial=0)), 1), np.zeros((len(mine), held.max(initial=0)), np.int64)
            at = np.repeat(np.arange(len(mine)), held), np.concatenate([np.zeros(0, np.int64), *map(np.arange, held)])
            value = scores.flatten().to_numpy()
            # without products that could leave a long: 100 * q + r
            q, r = value // 100, value % 100
            lo[at], hi[at] = share[0] * q - (-share[0] * r // 100), share[1] * q + share[1] * r // 100
            usable = lambda i, j: labels[mine[i]][:, None] != labels[theirs[j]][None, :]
        found, score, there = best(x[mine], x[theirs], lo, hi, k, usable)
        which, search = np.nonzero(there.any(axis=2))
        some = there[which, search]
        ends = np.concatenate(([0], some.sum(axis=1).cumsum())).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(ids[theirs[found[which, search][some]]]), pa.array(score[which, search][some])], names=["vec_id", "score"])
        out = pa.table({"anchor": pa.array(number[mine[which]]), "anchor_id": pa.array(ids[mine[which]]), "search": pa.array(search.astype(np.int32)), "found": pa.ListArray.from_arrays(pa.array(ends), pairs)})
        del x, table
        trim()
        return out

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    each = found.select("anchor", "anchor_id", "search", F.inline("found"))
    first = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor (rows that meet the condition ``anchors`` on vec_id) and each of its positives the hardest negatives.

    Scores are inner products of vectors with components floor(scale * x).  Positives are the rows of the anchor's label with the
    highest scores; negatives of a positive are the rows of other labels with the highest scores between ``least`` and ``most``
    hundredths of the positive's; ties go to the smaller vec_id.  Fewer than asked for give all.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  Rows with a null id, label or vector, an
    empty vector, a null or non-finite component, or a length whose square (scaled) leaves the longs take no part; vectors of different
    dimension don't meet.  Rows that share the anchor's id are not its positives; otherwise rows that repeat an id are rows of
    their own, as anchors too.  An empty table gives no rows; other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    rows = written(_packed(vectors, id_col, vector_col, label_col, scale), "vectors")
    asking = rows.filter(anchors)
    near = _met(rows, asking, ["dim", "label"]).groupBy("dim", "label", "segment", "block").applyInArrow(_search(positives, None), FOUND)
    chosen = written(_best(near, positives).select("anchor", "anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("s"))
    scores = scores.select(F.col("anchor").alias("row"), F.col("s.positive_score").alias("scores"))
    asking = written(asking.join(scores, "row"), "anchors")
    far = _met(rows, asking, ["dim"]).groupBy("dim", "segment", "block").applyInArrow(_search(negatives, (least, most)), FOUND)
    hard = _best(far, negatives).select("anchor", F.col("search") + 1, "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    hard = hard.toDF("anchor", "positive", "rank", "negative_id", "negative_score")
    pairs = chosen.withColumnRenamed("rank", "positive").join(hard, ["anchor", "positive"])
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
