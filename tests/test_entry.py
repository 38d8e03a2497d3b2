"""The driver's entry with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["tessera/llm", "tests/llm"], ["tessera/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_load_without(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        if (at / name).is_dir():
            shutil.rmtree(at / name)
        elif (at / name).exists():
            (at / name).unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=at, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.splitlines()
    queries, sqls = (set(x.split()) for x in said[-2:])
    assert "claim_weight" in queries and "pipeline" not in queries and sqls <= queries
    assert not (at / "tessera/llm").exists() or any(q.startswith("op1_") for q in queries)
    assert (at / "tessera/llm").exists() or not any(q.startswith("op") and "_" in q and q[2].isdigit() for q in queries)


def test_queries_load_where_a_package_is_missing():
    """What the training-data operators need may be missing; the other queries stay."""
    blocked = "import sys; sys.modules['xxhash'] = None; " + NAMES
    said = subprocess.run([sys.executable, "-B", "-c", blocked], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.splitlines()
    queries, sqls = (set(x.split()) for x in said[-2:])
    assert "claim_weight" in queries and sqls <= queries and not any(q.startswith("op1_") for q in queries)


def test_sorts_of_constraints_are_dealt_by_rows(spark, monkeypatch):
    """More rows go to more parts, not to larger ones; broken rows are the same."""
    from tessera.plans import working

    sf, run = "/root/testdata/sf0.001", working.validate_constraints
    want = sorted(map(tuple, run(working.Evidence(spark, sf)).collect()))
    kind = type(spark.range(0))
    parts, dealt = [], kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, n, *c: (parts.append(n), dealt(df, n, *c))[1])
    monkeypatch.setattr(working, "SORTED_ROWS", 600)
    assert sorted(map(tuple, run(working.Evidence(spark, sf)).collect())) == want and parts == [10] * 3


def test_pages_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        for name in ("html_text", "page_refusal"):
            spark.conf.set(key, "10000")
            __import__("__spark_entry__").queries()[name](spark, "/root/testdata/sf0.001").collect()
            assert int(spark.conf.get(key)) <= 500
        spark.conf.set(key, "20")
        __import__("__spark_entry__").queries()["html_text"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "20"
    finally:
        spark.conf.set(key, before)
