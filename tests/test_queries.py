"""Every registered query against its SQL, on the smallest tables where they are there."""

import os

import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rounded(rows):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows), key=str)


def test_queries_match_their_sql(spark):
    import duckdb

    from timelens import queries

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    wrong = []
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        got = con.execute(sql)
        columns = [c[0] for c in got.description]
        if sorted(columns) != sorted(df.columns) or rounded(df.select(*[f"`{c}`" for c in columns]).collect()) != rounded(got.fetchall()):
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
