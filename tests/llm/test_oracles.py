"""The queries that SQL can express, against it."""

import os

import duckdb
import pytest

pytest.importorskip("wearstream.llm")
from wearstream.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(map(str, ([r[c] for c in columns] for r in df.collect())))
    assert got == sorted(map(str, ([dict(zip(want.columns, r))[c] for c in columns] for r in want.fetchall())))
