"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.TEXT_QUERIES}
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.TEXT_QUERIES}


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    assert compare(spark, tables, SF_DIR, name, QUERIES[name], SQL[name]) is None
