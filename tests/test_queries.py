"""Every registered query with SQL equals it in DuckDB on the smallest tables; entry() has rows."""

import pytest

import __spark_entry__ as entry
from chronolith.plans.catalogue import QUERIES, SQL
from tools.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, name, SF)
    assert "DIFFER" not in said, said
    assert ("no oracle" in said) == (name not in SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
