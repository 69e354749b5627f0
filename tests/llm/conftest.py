from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame in several partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
