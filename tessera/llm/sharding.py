"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts are one atomic group; groups are ordered by (size
descending, key).  In that order the sequence of sizes is given by its runs of
equal sizes, so the search for the smallest feasible capacity needs only one
number pair per distinct group size, however many groups there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.runtime import written

#: Bytes that a row counts beside its text.
ROW_BYTES = 16
#: Parts into which a shard's rows are dealt for numbering.
SLOT_PARTS = 256
#: Groups of one size that the driver reads to find a cut among them.
CUT_KEYS = 10_000


class Runs:
    """Ordered groups as runs of equal sizes; positions count groups from 0."""

    def __init__(self, sizes: list[int], counts: list[int]):
        self.size = np.array(sizes, np.int64)
        self.group_at = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
        self.byte_at = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) * self.size)))
        self.groups, self.bytes = int(self.group_at[-1]), int(self.byte_at[-1])

    def before(self, position: int) -> int:
        """Bytes of the groups before a position."""
        r = min(int(np.searchsorted(self.group_at, position, "right")) - 1, len(self.size) - 1)
        return int(self.byte_at[r] + (position - self.group_at[r]) * self.size[r])

    def reach(self, start: int, capacity: int) -> int:
        """The furthest position such that the groups from start to it fit."""
        room = self.before(start) + capacity
        if room >= self.bytes:
            return self.groups
        r = int(np.searchsorted(self.byte_at, room, "right")) - 1
        return int(self.group_at[r] + (room - self.byte_at[r]) // self.size[r])

    def fits(self, start: int, shards: int, capacity: int) -> bool:
        """Whether greedy filling from start needs no more than so many shards."""
        for _ in range(shards):
            if start >= self.groups:
                return True
            after = self.reach(start, capacity)
            if after == start:
                return False
            start = after
        return start >= self.groups


def smallest_capacity(runs: Runs, shards: int) -> int:
    """Binary search for the smallest capacity with which greedy filling succeeds."""
    low, high = 0, runs.bytes
    while low < high:
        mid = (low + high) // 2
        if runs.fits(0, shards, mid):
            high = mid
        else:
            low = mid + 1
    return low


def cuts(runs: Runs, shards: int) -> list[int]:
    """Start positions of shards 1.. : none exceeds the smallest capacity, and each ends
    as near to the mean of what is left as the capacity of the rest allows."""
    capacity, start, out = smallest_capacity(runs, shards), 0, []
    for left in range(shards, 1, -1):
        mean = (runs.bytes - runs.before(start)) // left
        at = max(runs.reach(start, mean), min(start + 1, runs.groups))
        more = min(at + 1, runs.groups)
        have = runs.before(start)
        if runs.before(more) - have <= capacity and abs(runs.before(more) - have - mean) < abs(runs.before(at) - have - mean):
            at = more
        if not runs.fits(at, left - 1, capacity):
            at = runs.reach(start, capacity)
        out.append(start := at)
    return out


def _keys_at(groups: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """For each (size, rank) the key of that rank (from 0) among the groups of that size.

    The keys' prefixes are narrowed by three hex digits at a time until few keys
    share one; every round is one job for all that is wanted."""
    state = {w: ("", w[1], CUT_KEYS + 1) for w in wanted}  # prefix, rank inside it, keys that share it
    while wide := {w: s for w, s in state.items() if s[2] > CUT_KEYS and len(s[0]) < 60}:
        n = len(next(iter(wide.values()))[0])
        inside = F.concat_ws("/", F.col("group_size").cast("string"), F.substring("group_key", 1, n)).isin(sorted({f"{w[0]}/{s[0]}" for w, s in wide.items()}))
        sizes = sorted({w[0] for w in wide})
        counted = groups.filter(F.col("group_size").isin(sizes) & inside).groupBy("group_size", F.substring("group_key", 1, n + 3).alias("p")).count().collect()
        for w, (prefix, rank, _) in wide.items():
            for p, c in sorted((r[1], r[2]) for r in counted if r[0] == w[0] and r[1].startswith(prefix)):
                if rank < c:
                    break
                rank -= c
            state[w] = (p, rank, c)
    match = F.lit(False)
    for w, (prefix, _, _) in state.items():
        match = match | ((F.col("group_size") == w[0]) & F.col("group_key").startswith(prefix))
    keys = groups.filter(match).select("group_size", "group_key").collect() if state else []
    return {w: sorted(r[1] for r in keys if r[0] == w[0] and r[1].startswith(prefix))[rank] for w, (prefix, rank, _) in state.items()}


def minimax_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows to ``shards`` shards of nearly equal bytes; rows with equal texts stay together.

    Returns the id column, size (UTF-8 bytes of the text plus 16), text_crc32,
    law ('bytes'), shard, slot (numbers the rows of a shard from 0 without gaps)
    and grown_shard (null: this law moves rows when a shard is added).  A null
    text counts as an empty one and groups with it.  Null and repeated ids are
    kept as rows (other columns are ignored); a group larger than the mean gets a shard of its own; with
    fewer groups than shards some stay empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias(id_col), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group_key"), F.monotonically_increasing_id().alias("row_no")), "rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("group_rows"))
    groups = written(groups, "groups")
    # a row of two numbers for each distinct size: k sizes need k * k / 2 bytes of text, so 100 TB have 14 million at most
    found = groups.groupBy("group_size").count().toArrow()
    sizes, number = found["group_size"].to_numpy(), found["count"].to_numpy()
    order = np.argsort(-sizes)
    runs = Runs(sizes[order], number[order])
    bounds: list[tuple[int, int]] = []
    for at in cuts(runs, shards) if len(sizes) else []:
        if at < runs.groups:
            r = int(np.searchsorted(runs.group_at, at, "right")) - 1
            bounds.append((int(runs.size[r]), int(at - runs.group_at[r])))
    keys = _keys_at(groups, sorted({b for b in bounds if b[1]}))
    shard: Column = F.lit(0)
    for size, key in ((b[0], keys.get(b, "")) for b in bounds):
        past = (F.col("group_size") < size) | ((F.col("group_size") == size) & (F.col("group_key") >= key))
        shard = shard + past.cast("int")
    copied = groups.filter("group_rows > 1").select("group_key", F.col("group_size").alias("copies_size"))
    placed = rows.join(copied, "group_key", "left").withColumn("group_size", F.coalesce("copies_size", "size"))
    placed = placed.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64(id_col, "group_key", F.when(F.col("copies_size").isNotNull(), F.col("row_no"))), F.lit(SLOT_PARTS)).cast("int"))
    placed = written(placed.select(id_col, "size", "text_crc32", "shard", "part"), "placed")
    counts = {(r[0], r[1]): r[2] for r in placed.groupBy("shard", "part").count().collect()}  # shards x SLOT_PARTS rows at most
    offsets = []
    for s in range(shards):
        at = 0
        for p in range(SLOT_PARTS):
            if (s, p) in counts:
                offsets.append((s, p, at))
                at += counts[s, p]
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType())])
    first = F.broadcast(spark.createDataFrame(offsets, schema))
    order = Window.partitionBy("shard", "part").orderBy(id_col, "text_crc32", "size")
    numbered = placed.withColumn("n", F.row_number().over(order)).join(first, ["shard", "part"])
    slot = (F.col("offset") + F.col("n") - 1).cast("long")
    return numbered.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
