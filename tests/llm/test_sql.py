"""Queries that have SQL against it, on the smallest tables where they are there."""

import os

import duckdb
import pytest

from timelens.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    wanted = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, wanted.fetchall()))
