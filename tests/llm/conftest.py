import pytest
from pyspark.sql import functions as F


@pytest.fixture
def clash():
    """A frame with extra columns named like internals of the operators."""
    def add(df):
        return df.withColumns({c: F.lit(1) for c in ("key", "h", "_tk", "score", "first", "n", "rank", "piece", "drop")})
    return add
