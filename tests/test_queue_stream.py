"""The queue and the reports as streams: batches, restarts, late entries and failures against a replay of everything."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.streaming import marks
from tessera.streaming import queue as Q

RULES = Q.Rules(lease_s=7200, backoff_s=600, most=2)
LOG = "task_id long, at timestamp, entry_id long, verb string"


def at(minutes):
    return pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("entries,want", [
    ([(0, "queued"), (1, "claimed"), (2, "done"), (3, "done"), (4, "failed")], ("done", 1, 0, 2)),
    ([(0, "claimed"), (1, "queued")], ("pending", 0, 0, 1)),
    ([(0, "queued"), (1, "claimed"), (2, "failed"), (5, "claimed"), (12, "claimed"), (13, "failed"), (99, "claimed")], ("dead", 2, 0, 2)),
    ([(0, "queued"), (1, "claimed"), (200, "claimed"), (201, "done")], ("done", 2, 1, 0)),
    ([(0, "queued"), (1, "claimed"), (200, "done")], ("pending", 1, 1, 1)),
    ([(0, "queued"), (1, "cancelled"), (2, "claimed")], ("cancelled", 0, 0, 1)),
    ([(0, "failed")], (None, 0, 0, 1)),
])
def test_rules(entries, want):
    s = Q.replay([(at(m), i, v) for i, (m, v) in enumerate(entries)], RULES)
    assert (s[0], s[1], s[4], s[5]) == want


def test_batches_restarts_and_late_entries_equal_a_replay(spark, tmp_path):
    rng = random.Random(1)
    rows = [(t, at(rng.randint(0, 600)).to_pydatetime(), 100 * t + e, rng.choice(["queued", "claimed", "claimed", "done", "failed"])) for t in range(40) for e in range(rng.randint(1, 9))]
    rng.shuffle(rows)  # so that every batch has entries behind those of others
    log, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/queue"
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(log)
    for k in range(0, len(rows), 90):  # a restart for each part, with a file that repeats entries and odd ones
        put(spark, log, rows[k : k + 90], LOG)
        put(spark, log, [*rows[k : k + 5], (None, at(1).to_pydatetime(), 1, "done"), (3, None, 1, "done"), (3, at(1).to_pydatetime(), 1, None)], LOG)
        states = Q.queue_states(stream(), RULES, folder)
    want = {t: Q.replay([(pd.Timestamp(a), e, v) for i, a, e, v in rows if i == t], RULES) for t in range(40)}
    got = {r.task_id: (r.state, r.attempts, r.scheduled_at, r.lease_until, r.orphaned, r.ignored) for r in states.collect()}
    assert {t: s[:2] + s[4:] for t, s in got.items()} == {t: s[:2] + s[4:] for t, s in want.items()} and len({s[0] for s in got.values()}) >= 4
    assert {t: s[3] for t, s in got.items()} == {t: None if s[3] is None else s[3].to_pydatetime() for t, s in want.items()}
    later = {r.task_id: r.state for r in Q.at_time(states, F.lit("2024-01-03").cast("timestamp")).collect()}
    assert "running" not in later.values() and all(later[t] == ("pending" if s[0] == "running" else s[0]) for t, s in got.items())


def test_marks_move_with_reports(spark, tmp_path):
    log, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/reports"
    schema, sent = "ts timestamp, what string", []
    stream = lambda: spark.readStream.schema(schema).parquet(log)

    def deliver(rows, number):
        sent.append((number, sorted((r.what, r.n, r.late) for r in rows.collect())))
        if len(sent) == 2:
            raise RuntimeError("not delivered")

    put(spark, log, [(at(m).to_pydatetime(), w) for m, w in ((1, "a"), (5, "a"), (3, "b"))], schema)
    marks.reported(stream(), folder, deliver)
    assert marks.mark(spark, f"{folder}/out") == at(5).to_pydatetime()
    put(spark, log, [(at(m).to_pydatetime(), w) for m, w in ((4, "a"), (9, "b"), (8, "c"))] + [(None, "d")], schema)
    with pytest.raises(Exception, match="not delivered"):
        marks.reported(stream(), folder, deliver)
    assert marks.mark(spark, f"{folder}/out") == at(5).to_pydatetime()  # neither report nor mark
    rows = marks.reported(stream(), folder, deliver)
    assert sent[1] == sent[2] and sent[2] == (1, [("a", 0, 1), ("b", 1, 0), ("c", 1, 0)])  # the same batch again, from the same mark
    assert marks.mark(spark, f"{folder}/out") == at(9).to_pydatetime()
    assert sorted((r.batch_no, r.what, r.n, r.late) for r in rows.collect()) == [(0, "a", 2, 0), (0, "b", 1, 0), (1, "a", 0, 1), (1, "b", 1, 0), (1, "c", 1, 0)]
    assert {r.since for r in rows.filter("batch_no = 1").collect()} == {at(5).to_pydatetime()}
    marks.reported(stream(), folder, deliver)  # nothing new
    assert len(sent) == 3 and marks.mark(spark, f"{folder}/out") == at(9).to_pydatetime()
    # a table that was begun and not completed doesn't count
    spark.createDataFrame([("x", 1, 0, None, at(99).to_pydatetime(), 7)], marks.REPORT).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/out/b00000007")
    assert marks.mark(spark, f"{folder}/out") == at(9).to_pydatetime()
