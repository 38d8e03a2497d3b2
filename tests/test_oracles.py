"""Every registered query against its SQL counterpart."""

import pytest

from compare import compare
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        compare(spark, SF, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_every_counterpart_has_a_query():
    assert set(SQL) <= set(QUERIES)
