"""Every registered query against its DuckDB statement."""

import pytest

import duckdb_checks
from __spark_entry__ import _planning_queries, entry
from check import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_a_statement():
    assert _planning_queries().keys() == duckdb_checks.oracle().keys()


@pytest.mark.parametrize("name", list(_planning_queries()))
def test_query(spark, db, name):
    assert differences(spark, db, SF, name) == []


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "part_no"
