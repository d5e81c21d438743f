"""Every query of the catalog against its SQL twin, at the smallest scale."""

import pytest
from compare import database, spark_rows, sql_rows

import __spark_entry__ as entry
from catalog.all import CATALOG

FOLDER = "/root/testdata/sf0.001"
SQL = CATALOG.sql


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query_equals_its_sql(spark, con, name):
    got = spark_rows(CATALOG.queries[name](spark, FOLDER))
    if name in SQL:
        assert got == sql_rows(con, SQL[name])
    else:
        assert got[1]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CATALOG.queries) <= set(entry.queries())
