from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rasterloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def value(spark):
    """Evaluate one column expression over one row of literals."""

    def run(column, **row):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*[F.lit(v).alias(n) for n, v in row.items()]) if row else spark.range(1)
        return df.select(column.alias("out")).first()[0]

    return run
