"""Landed responses through the data source: paths, filters that leave out files, streams that go on."""

import json

from pyspark.sql import functions as F

from tessera.sources import landed as L
from tessera.streaming.deltas import run_available

FIELDS = {"id": "a.0.id", "n": "n", "all": "a", "none": "x.y"}


def put(folder, name, lines):
    at = folder / name
    at.parent.mkdir(exist_ok=True, parents=True)
    at.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_paths():
    value = {"a": [{"id": "é"}, 5, None], "b": {"c": True}, "5": "five"}
    assert [L.at_path(value, p) for p in ("a.0.id", "a.1", "a.2", "a.9", "a.x", "b.c", "b", "5", "a.0.id.z", "q")] == ["é", "5", None, None, None, "true", '{"c":true}', "five", None, None]
    assert L.at_path(None, "a") is None and L.at_path([["x"]], "0.0") == "x"


def test_files_and_filters(spark, tmp_path):
    put(tmp_path, "day=1/p1.json", [{"a": [{"id": 7}], "n": 1}, "{cut", "", [1, 2]])
    put(tmp_path, "day=1/p2.json", [{"n": "2"}])
    put(tmp_path, "day=2/p1.json", [{"n": None}])
    put(tmp_path, "day=2/.hidden", [{"n": 9}])
    put(tmp_path, "_SUCCESS", [])
    put(tmp_path, "empty.json", [])
    rows = L.landed(spark, f"file://{tmp_path}", FIELDS, part_bytes=1)
    assert rows.columns == ["file", *FIELDS]
    got = sorted((r.file, r.id, r.n, r["all"], r.none) for r in rows.collect() if r.n or r.id)
    assert got == [("day=1/p1.json", "7", "1", '[{"id":7}]', None), ("day=1/p2.json", None, "2", None, None)] and rows.count() == 6
    for condition, parts, n in ((F.col("file").startswith("day=1/"), 2, 5), (F.col("file") == "day=2/p1.json", 1, 1), (F.col("file").isin("day=1/p2.json", "nowhere"), 1, 1), (F.col("n") == "2", 4, 1), (F.col("file") == "nowhere", 1, 0)):
        some = rows.filter(condition)
        assert some.count() == n and some.rdd.getNumPartitions() == parts


def test_stream_goes_on_behind_the_last_file(spark, tmp_path):
    log, at = tmp_path / "log", f"file://{tmp_path}/stream"
    put(log, "a1.json", [{"n": 1}])
    stream = lambda: L.landed(spark, f"file://{log}", {"n": "n"}, stream=True)
    assert [r.n for r in run_available(stream(), "landed", at=at).collect()] == ["1"]
    put(log, "a2.json", [{"n": 2}, {"n": 3}])
    assert sorted(r.n for r in run_available(stream(), "landed", at=at).collect()) == ["1", "2", "3"]
    assert sorted(r.n for r in run_available(stream(), "landed", at=at).collect()) == ["1", "2", "3"]
