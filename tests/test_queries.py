import pytest
from duck import check, connect

from siltstone.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, data, con, name):
    check(QUERIES[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0


def test_no_stored_filter_denies_its_keys(spark, data):
    assert QUERIES["bloom_stored"](spark, data).filter("n_denied > 0").count() == 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
