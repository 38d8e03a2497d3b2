"""Streams that get a second file, after a restart, and late events."""

from pyspark.sql import functions as F

from tessera.streaming import deltas

COLUMNS = "event_id long, ts timestamp, user_id long, event_type string"


def put(spark, folder, number, rows):
    df = spark.createDataFrame([(i, None, u, t) for i, _, u, t in rows], COLUMNS).drop("ts").join(spark.createDataFrame([(i, at) for i, at, *_ in rows], "event_id long, at string"), "event_id")
    df.select("event_id", F.to_timestamp("at").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_counts_go_on_after_a_restart(spark, tmp_path):
    at = f"file://{tmp_path}/stream"
    put(spark, tmp_path, 1, [(1, "2024-01-01 10:00:00", 1, "view"), (2, "2024-01-01 11:00:00", 2, "view"), (3, "2024-01-02 10:00:00", 1, "click")])
    first = {(str(r.day), r.event_type): r.n for r in deltas.daily_counts(spark, str(tmp_path), at).collect()}
    assert first == {("2024-01-01", "view"): 2, ("2024-01-02", "click"): 1}
    put(spark, tmp_path, 2, [(4, "2024-01-01 23:00:00", 3, "view"), (5, "2024-01-03 10:00:00", 1, "view")])  # a late one, and a new day
    second = {(str(r.day), r.event_type): r.n for r in deltas.daily_counts(spark, str(tmp_path), at).collect()}
    assert second == {("2024-01-01", "view"): 3, ("2024-01-02", "click"): 1, ("2024-01-03", "view"): 1}
    assert {(str(r.day), r.event_type): r.n for r in deltas.daily_counts(spark, str(tmp_path), at).collect()} == second  # nothing new


def test_keys_are_seen_once_across_restarts(spark, tmp_path):
    at = f"file://{tmp_path}/stream"
    put(spark, tmp_path, 1, [(1, "2024-01-05 10:00:00", 1, "view"), (2, "2024-01-05 10:30:00", 1, "view"), (3, "2024-01-05 11:00:00", 1, "view")])
    deltas.first_seen(spark, str(tmp_path), at=at)
    put(spark, tmp_path, 2, [(4, "2024-01-05 10:45:00", 1, "view"), (5, "2024-01-05 12:00:00", 1, "view"), (6, "2024-01-01 01:00:00", 1, "view"), (7, "2024-01-01 01:30:00", None, "view")])  # one seen, one new, two very late
    got = [str(r.hour) for r in deltas.first_seen(spark, str(tmp_path), at=at).collect()]
    assert sorted(got) == ["2024-01-01 01:00:00"] * 2 + ["2024-01-05 10:00:00", "2024-01-05 11:00:00", "2024-01-05 12:00:00"]
    put(spark, tmp_path, 3, [(8, "2024-01-01 01:50:00", None, "view"), (9, "2024-01-01 01:55:00", 1, "view")])
    assert sorted(str(r.hour) for r in deltas.first_seen(spark, str(tmp_path), at=at).collect()) == sorted(got)  # late ones are seen once, too
