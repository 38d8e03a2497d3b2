"""Registration of queries and their SQL counterparts by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.evidence import Evidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the evidence tables under a name."""

    def add(f: Callable[[Evidence], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Evidence(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add
