"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    text, _, good = compare(spark, con, FOLDER, name, queries()[name], SQL.get(name))
    assert good, text


def test_entry_has_rows(spark):
    assert entry(spark).count() == 6


def test_sql_names_are_queries():
    assert set(SQL) <= set(queries())
