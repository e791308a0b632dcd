"""Every query of the catalog against its DuckDB counterpart."""

import pytest

import __spark_entry__
from scriptorium.plans import catalog
from tests.comparing import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_agrees_with_duckdb(spark, duck, name):
    assert difference(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert len(df.collect()) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
