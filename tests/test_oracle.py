"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracle import compare, duck

from benchloom.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    message, ok = compare(spark, con, small, name, QUERIES[name], ORACLE.get(name))
    assert ok, f"{name}: {message}"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
