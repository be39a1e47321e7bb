import pytest
from duck import check, connect

from siltstone.llm.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, data, name):
    check(QUERIES[name](spark, data), connect(data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_over_whole_tables(spark, data, name):
    df = QUERIES[name](spark, data)
    n = df.count()
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    assert n >= docs if name in ("p6_ids", "p7_packing", "p8_redacted") else n > 0
