"""Every query of the core against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from tidewire.plans import oracles, queries


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(name, spark, sf, duck):
    df = queries.QUERIES[name](spark, sf)
    sql = oracles.ORACLES.get(name)
    if sql is None:
        assert df.count() > 0  # its rows are tested by brute force elsewhere
    else:
        assert compare(df, duck, sql) == ""


def test_every_query_has_a_name_and_no_foreign_sql():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
