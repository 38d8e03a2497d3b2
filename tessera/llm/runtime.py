"""Session helpers of the training-data operators: shared folder, written tables, batch limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch handed to Python; long texts make rows heavy.
ARROW_ROWS = 1000


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(f):
    """A batch function that trims its worker's memory when its task is done."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    A session on one machine (master local) that has none, as in tests, gets a temporary one; a cluster must name its folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch unless the session already has a smaller bound.

    The setting is the session's: plans are run after an operator has returned, so it can't be put back here.
    It only makes batches smaller and changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


#: Folders written so far, by application.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back; cuts lineage and survives executors.

    ``clear`` deletes the folders when what was made from them is used up."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(at)
    return spark.read.schema(df.schema).parquet(at)


def written_so_far(spark: SparkSession) -> int:
    """The number of folders that this application has written and not cleared."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> int:
    """Delete what this application has written but for the first ``since`` folders and those that ``but`` reads; the number of folders that stay.

    Results of operators are lazy: clear only when they are written or no longer wanted."""
    held = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    read = but.inputFiles() if but is not None else []
    kept = held[:since]
    for at in held[since:]:
        name = at.rsplit("/", 1)[1]
        if any(f"/{name}/" in f for f in read):
            kept.append(at)
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    held[:] = kept
    return len(kept)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Least and most bits of the filters that keep rows without a partner from being shuffled, and bits for each key.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 20, 27, 10


def _probes(keys, bits: int):
    import numpy as np

    from tessera.llm.arrow_text import mix

    h = mix(keys.view(np.uint64))
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64), (h >> np.uint64(64 - bits)).astype(np.int64)


def key_filter(keys: DataFrame):
    """A broadcast bitmap of the (written) keys, one long column: absent keys mostly fail ``may_have``, present ones never.

    It has BITS_A_KEY bits for each key up to 1 << MOST_BITS bits (16 MB), a bound on what
    is broadcast; with more keys it lets more rows through, which costs a larger shuffle
    behind it and changes no result.  Tasks make blocks of the bitmap where it is merged, in parallel."""
    import numpy as np
    import pyarrow as pa

    spark = keys.sparkSession
    name = keys.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, int(keys.count() * BITS_A_KEY).bit_length()))
    block = max(LEAST_BITS - 4, bits - 6)

    def mark(batches):
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            for p in _probes(batch.column(0).to_numpy(), bits):
                held[p] = True
        some = np.flatnonzero(held.reshape(-1, 1 << block).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([np.packbits(held[k << block : (k + 1) << block]).tobytes() for k in some.tolist()], pa.binary())], names=["block", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        all_ = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table["bits"]])
        return pa.table({"block": table["block"][:1].combine_chunks(), "bits": pa.array([all_.tobytes()], pa.binary())})

    whole = np.zeros((1 << bits) // 8, np.uint8)
    schema = "block long, bits binary"
    blocks = keys.select(name).mapInArrow(trimmed(mark), schema).groupBy("block").applyInArrow(merge, schema)
    for r in blocks.toLocalIterator():
        whole[r[0] << block >> 3 : (r[0] + 1) << block >> 3] = np.frombuffer(r[1], np.uint8)
    return spark.sparkContext.broadcast(whole)


def may_have(bitmap, keys):
    """Whether each key may be among those of the filter."""
    import numpy as np

    out = np.ones(len(keys), bool)
    for p in _probes(np.ascontiguousarray(keys), len(bitmap).bit_length() + 2):
        out &= (bitmap[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return out
