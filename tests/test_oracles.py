"""Every query with a SQL twin gives the same rows at sf0.001."""

from __future__ import annotations

import pytest

from cuemill.plans import catalog
from tests.comparing import connection, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck, ORACLES[name])


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
