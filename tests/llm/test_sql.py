"""Queries of the training-data operators against their SQL, at the smallest size."""

import pytest

from firmlake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    import duckdb

    from tests.test_queries import TABLES, plain

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns, theirs = sorted(df.columns), c.sql(queries.oracle_sql()[name])
    at = [theirs.columns.index(x) for x in columns]
    assert sorted(theirs.columns) == columns
    assert sorted(tuple(plain(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in theirs.fetchall())
