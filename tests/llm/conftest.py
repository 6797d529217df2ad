import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture
def frame(spark):
    """Rows of Python values as a DataFrame with a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
