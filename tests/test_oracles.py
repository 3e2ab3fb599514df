"""Every registered query against its SQL on whole tables."""

from __future__ import annotations

import pytest
from check import compare, connect

from __spark_entry__ import entry
from rasterloom.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, db, name):
    assert compare(all_queries()[name](spark, SF), db, all_oracles()[name]) == ""


def test_every_query_has_sql():
    assert set(all_oracles()) == set(all_queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 1500 and "aspect_ratio" in df.columns
