"""Every query over empty tables, and over events with nulls, ties and repeated times: none may fail."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from wearstream import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def spoilt(name, df):
    if name != "events":
        return df
    k = F.col("event_id")
    hour = F.when(k % 5 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    return df.withColumns({"value": F.when(k % 19 != 3, F.col("value")), "user_id": F.when(k % 37 != 5, F.col("user_id")), "ts": hour})


@pytest.fixture(scope="module", params=["empty", "spoilt"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        (df.where("false") if request.param == "empty" else spoilt(t, df)).coalesce(1).write.parquet(f"{path}/{t}.parquet")
    return path


def test_no_query_fails(spark, folder):
    with ThreadPoolExecutor(8) as pool:
        runs = {name: pool.submit(lambda q=query: q(spark, folder).collect()) for name, query in catalog.queries().items()}
    assert {name: str(run.exception())[:300] for name, run in runs.items() if run.exception()} == {}
