"""Tables and stream states in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new place in ``spark.checkpoint.dir``; only a session on one machine may do without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-tables-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again: worked out once, and kept when executors are lost."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows with whole texts in one Arrow batch that is handed to Python.
TEXT_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of the session's Arrow batches, unless they are bounded more; changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


Made = TypeVar("Made")
#: What applications have stored so far, by application, name and the state of the files that it comes from.
_KEPT: dict[tuple, object] = {}


def kept(source: DataFrame, name: str, make: Callable[[], Made]) -> Made:
    """What ``make`` stores, made once for an application and the files of ``source`` as they are (paths, lengths, times)."""
    spark = source.sparkSession
    conf, path, uri = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI
    states = []
    for at in sorted(source.inputFiles()):
        file = path(uri(at))  # names come encoded
        status = file.getFileSystem(conf).getFileStatus(file)
        states.append((at, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(states))
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]
