"""What only larger tables showed: values on a limit, long lists of recipients."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wearstream.operators import records as O
from wearstream.plans import sites, views
from wearstream.streaming.emergencies import emergencies, packets


@pytest.fixture(scope="module")
def limit(spark, tmp_path_factory):
    """A worker whose last value is exactly 90, which has no place, after one of 45, which has."""
    path = str(tmp_path_factory.mktemp("limit"))
    rows = [(1, dt.datetime(2024, 1, 1), 7, "view", 45.0), (2, dt.datetime(2024, 1, 2), 7, "view", 90.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(7, "w")], "c_custkey long, c_name string").write.parquet(f"{path}/customer.parquet")
    return path


def test_the_last_position_is_below_the_limit(spark, limit):
    assert [tuple(r) for r in sites.d18_last_position(spark, limit).collect()] == [(7, 45.0, 90.0)]


def test_the_snapshot_has_the_last_position_below_the_limit(spark, limit):
    assert [r["lat"] for r in views.l08_snapshot(spark, limit).collect()] == [45.0]


def test_alerts_go_to_any_number_of_recipients(spark):
    alerts = spark.createDataFrame([(1, 5), (2, 20_000), (3, None), (2, 20_000)], "event_id long, worker long")
    to = O.fanned_out(alerts, spark.range(12_000).withColumnRenamed("id", "recipient"), "worker")
    assert {r["event_id"]: (r["n"], r["d"]) for r in to.groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("recipient").alias("d")).collect()} == {1: (12_000,) * 2, 2: (12_001,) * 2, 3: (12_000,) * 2}


def test_a_fan_out_takes_little_disk_and_goes_on_in_many_tasks(spark, tmp_path):
    alerts, recipients = spark.range(5000).selectExpr("id * 5 event_id", "id % 4000 + 100000 worker"), spark.range(2003).selectExpr("id * 49 recipient")
    O.fanned_out(alerts, recipients, "worker").write.parquet(f"{tmp_path}/to")
    files = list((tmp_path / "to").glob("*.parquet"))
    to = spark.read.parquet(f"{tmp_path}/to")
    assert to.distinct().count() == to.count() == 5000 * 2004
    assert sum(f.stat().st_size for f in files) < 0.3 * 5000 * 2004 and len(files) > 4


def test_alerts_without_number_or_given_often_go_to_each_recipient_once(spark):
    alerts = spark.createDataFrame([(None, 5), (None, 6), *[(7, 1)] * 3000, *[(7, None)] * 2000], "event_id long, worker long")
    to = O.fanned_out(alerts, spark.createDataFrame([(1,), (2,), (2,), (None,)], "recipient long"), "worker")
    assert sorted(map(tuple, to.collect()), key=str) == [(7, 1), (7, 2), (None, 1), (None, 2), (None, 5), (None, 6)]
    assert O.fanned_out(alerts.where("false"), to.select("recipient"), "worker").count() == 0
    assert sorted(map(tuple, O.fanned_out(alerts, to.select("recipient").where("false"), "worker").collect()), key=str) == [(7, 1), (None, 5), (None, 6)]


def test_a_tables_replay_keeps_its_tasks(spark):
    actions = spark.range(1000).selectExpr("id worker", "id seq", "id us", "'H' helmet", "'press' action", "1D lat", "1D lon")
    out = emergencies(actions)
    assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and out.count() == 1000


def test_packets_are_read_once_for_a_row(spark):
    rows = packets(spark.createDataFrame([('{"helmetId": "H"}',)], "value string"))
    plan = rows.select("problems", "us")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("variant_get(") <= 16 and rows.first()["problems"] == ["NO_TIME", "NO_EMERGENCY"]
