import os

import duckdb
import pytest

from wearstream import catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(map(str, ([r[c] for c in columns] for r in df.collect())))
    rows = sorted(map(str, ([dict(zip(want.columns, r))[c] for c in columns] for r in want.fetchall())))
    assert len(got) == len(rows)
    assert got == rows
