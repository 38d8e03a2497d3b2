"""The work queue as a stream of log entries: each task's state is kept across batches and restarts.

A task's entries are held in order in the stream's state, so that an entry that comes late, whatever its time, leads to
the state that it would have led to in time.  What a lease's end does is a matter of the time of reading (``at_time``)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.sources import shared

ENTRY = "at timestamp, entry_id long, verb string"
STATE = "task_id long, state string, attempts int, scheduled_at timestamp, lease_until timestamp, orphaned int, ignored int, entries int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rules(NamedTuple):
    """Seconds of a lease, seconds before the first retry (doubled for each attempt), and attempts until a failure is final."""

    lease_s: int = 7200
    backoff_s: int = 5
    most: int = 3


def replay(entries: Iterable[tuple], rules: Rules) -> tuple:
    """state, attempts, scheduled_at, lease_until, orphaned and ignored after a task's entries (at, entry_id, verb) in order.

    A task is queued once.  It is claimed when it waits and its time has come; it ends, fails or is given up only while it is
    claimed, so that a second end changes nothing.  A failure waits longer after each attempt until all are used up.  A claim that nobody has ended
    within the lease is an orphan, which waits again and keeps its attempts."""
    state, attempts, scheduled, until, orphaned, ignored = None, 0, None, None, 0, 0
    for at, _, verb in sorted(entries):
        if state == "running" and at > until:
            state, scheduled, until, orphaned = "pending", until, None, orphaned + 1
        if verb == "queued" and state is None:
            state, scheduled = "pending", at
        elif verb == "claimed" and state == "pending" and scheduled <= at:
            state, attempts, until = "running", attempts + 1, at + pd.Timedelta(seconds=rules.lease_s)
        elif verb == "done" and state == "running":
            state, until = "done", None
        elif verb == "failed" and state == "running":
            until = None
            if attempts >= rules.most:
                state = "dead"
            else:
                state, scheduled = "pending", at + pd.Timedelta(seconds=rules.backoff_s * 2 ** (attempts - 1))
        elif verb == "cancelled" and state in ("pending", "running"):
            state, until = "cancelled", None
        else:
            ignored += 1
    return state, attempts, scheduled, until, orphaned, ignored


class _Queue(StatefulProcessor):
    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.log.get()) if self.log.exists() else []
        new = [(t.to_pydatetime(), int(e), v) for part in rows for t, e, v in zip(part["at"], part["entry_id"], part["verb"])]
        self.log.put([*held, *new])
        every = {(pd.Timestamp(t), e, v) for t, e, v in [*held, *new]}  # an entry that is delivered again is the same
        out = replay(every, self.rules)
        yield pd.DataFrame([(key[0], *out, len(every))], columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


def queue_states(log: DataFrame, rules: Rules = Rules(), at: str | None = None) -> DataFrame:
    """The state of every task after a stream of entries (task_id, at, entry_id, verb), as far as there are entries.

    ``at`` is a folder that a later run goes on from.  Each batch writes the tasks that it has touched under its number, so that one that
    runs again replaces itself; the last batch of a task has its state.  Entries without a task, a time or a verb are left out."""
    spark = log.sparkSession
    at = at or shared.folder(spark, "queue")
    entries = log.filter("task_id is not null and at is not null and verb is not null").select(F.col("task_id").cast("long").alias("task_id"), "at", F.col("entry_id").cast("long").alias("entry_id"), "verb")
    states = entries.groupBy("task_id").transformWithStateInPandas(_Queue(rules), STATE, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/b{number:08d}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)  # what state of this kind needs; a stream keeps the setting that it was started with
    try:
        run = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    run.awaitTermination()
    rows = spark.read.schema(f"{STATE}, batch_no int").parquet(f"{at}/out/*")
    columns = [c.split()[0] for c in STATE.split(", ")]
    return rows.groupBy("task_id").agg(F.max_by(F.struct(*columns[1:]), "batch_no").alias("s")).select("task_id", "s.*")


def at_time(states: DataFrame, now: Column) -> DataFrame:
    """The states as they are at a time: claims whose lease is over wait again."""
    over = F.coalesce((F.col("state") == "running") & (F.col("lease_until") < now), F.lit(False))
    return states.withColumn("state", F.when(over, "pending").otherwise(F.col("state"))).withColumn("orphaned", F.col("orphaned") + over.cast("int"))
