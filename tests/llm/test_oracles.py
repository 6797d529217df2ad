"""The operators that SQL can express, against DuckDB."""

import pytest
from check_oracle import compare, duck

from benchloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, name):
    message, ok = compare(spark, duck(small), small, name, QUERIES[name], ORACLE[name])
    assert ok, f"{name}: {message}"
