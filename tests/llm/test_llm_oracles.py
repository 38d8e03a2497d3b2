"""Queries of this subpackage against their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from compare import compare  # noqa: E402
from tessera.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", queries.queries()[name], queries.oracle_sql()[name]) > 0
