"""Queries that have SQL against it, in DuckDB on the same tables."""

import os

import duckdb
import pytest

from listloom.llm import registry


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    mine, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, mine[columns].to_numpy().tolist())) == sorted(map(tuple, theirs[columns].to_numpy().tolist()))
