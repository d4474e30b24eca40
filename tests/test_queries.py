"""Every registered query runs; those with SQL give the same rows as DuckDB does."""

import pytest
from oracle import both, duck

import lakemill.catalog as catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, con, name):
    got, want = both(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.collect() is not None
