"""Exchange of compact key entries: rows of many keys packed into one binary per bucket.

Moving (key, node, size, flag) entries as packed arrays costs a small part of what
moving them as rows does; each bucket is then sorted in numpy by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.arrow_text import mix
from tessera.llm.runtime import parts, small_batches, trim, trimmed

ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<i4"), ("flag", "<i4")])
#: Entries that a task gathers before it sends them.
GATHERED = 700_000


def exchange(rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[np.ndarray]], reduce: Callable[[np.ndarray], pa.Table], schema: str, per_part: int = 4, add: bool = False, dtype: np.dtype = ENTRY, hot: int = 0) -> DataFrame:
    """Apply ``entries`` to batches, bring entries of equal keys together, apply ``reduce`` to each bucket.

    ``reduce`` gets the bucket's entries without repeats, sorted by (key, node).
    With ``add`` the sizes of repeated (key, node) entries are summed, else they
    are alike.  Entries whose flag is ``hot`` or more (if that is set) have keys of very
    long lists, which are dealt over all buckets.  The number of buckets follows spark.sql.shuffle.partitions, so a bucket's
    size doesn't follow the input's."""
    def distinct(e: np.ndarray) -> np.ndarray:
        """Entries sorted by (key, node), without repeats."""
        e = e[np.lexsort((e["node"], e["key"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["node"][1:] != e["node"][:-1])
        if not add or new.all():
            return e[new]
        out = e[new]
        out["size"] = np.add.reduceat(e["size"], np.flatnonzero(new))
        return out

    spark = rows.sparkSession
    n = parts(spark) * per_part

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def packed() -> pa.RecordBatch:
            all_ = distinct(np.concatenate(held))
            held.clear()
            by = all_["key"] >> np.uint64(32)
            if hot:
                by = np.where(all_["flag"] >= hot, mix(all_["node"].view(np.uint64)) >> np.uint64(32), by)
            bucket = (by % np.uint64(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            all_, bucket = all_[order], bucket[order]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(edge[1:], len(all_))
            # column by column, so that the equal bytes of ids and sizes lie together and compress
            blobs = [b"".join(np.ascontiguousarray(all_[f][a:b]).tobytes() for f in dtype.names) for a, b in zip(edge.tolist(), ends.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for e in entries(batch):
                if len(e):
                    held.append(e)
                    count += len(e)
                if count >= GATHERED:
                    yield packed()
                    count = 0
        if held:
            yield packed()

    def receive(table: pa.Table) -> pa.Table:
        out = []
        for blob in table["blob"]:
            raw = blob.as_buffer()
            m = raw.size // dtype.itemsize
            e = np.empty(m, dtype)
            at = 0
            for f in dtype.names:
                e[f] = np.frombuffer(raw, dtype[f], m, at)
                at += m * dtype[f].itemsize
            out.append(e)
        done = reduce(distinct(np.concatenate(out)))
        del out
        trim()
        return done

    small_batches(spark)
    return rows.mapInArrow(trimmed(send), "bucket int, blob binary").groupBy("bucket").applyInArrow(receive, schema)


def groups_of(entries: np.ndarray, least: int = 2) -> Iterator[np.ndarray]:
    """Runs of equal keys with at least so many entries."""
    key = entries["key"]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(key))
    for k in np.flatnonzero(ends - edge >= least).tolist():
        yield entries[edge[k] : ends[k]]
