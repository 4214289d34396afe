"""A table's rows give the same result whatever its files."""

import pytest
from pyspark.sql import functions as F

from wearstream import catalog
from wearstream.streaming import stateful


@pytest.mark.parametrize("name", ["f10_gate", "f15_emergencies"])
def test_one_file_and_a_hundred_shuffled_give_equal_rows(spark, tmp_path, name):
    kinds = F.element_at(F.array(*map(F.lit, ("error", "purchase", "click", "view"))), (F.xxhash64("event_id") % 4 + 4).cast("int") % 4 + 1)
    events = spark.range(3000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5).cast("long").alias("user_id"),
        F.timestamp_micros(F.col("id") * 900_000_000 + F.pmod(F.xxhash64("id"), F.lit(5)) * 1_800_000_000).alias("ts"), F.lit(1.0).alias("value"),
    ).withColumn("event_type", kinds)
    events.coalesce(1).write.parquet(str(tmp_path / "one/events.parquet"))
    events.repartition(100, F.xxhash64("event_id")).write.parquet(str(tmp_path / "many/events.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        one, many = ([tuple(r) for r in catalog.queries()[name](spark, str(tmp_path / d)).orderBy("seq").collect()] for d in ("one", "many"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(one) == 3000 and one == many


def test_table_keeps_phases_between_batches_and_null_workers(spark):
    rows = [(w, i, i, a) for w in (1, None) for i, a in enumerate(("press", "request", "ack", "ack", None))]
    got = stateful.emergencies(spark.createDataFrame(rows[::-1], "worker long, seq long, us long, action string")).collect()
    want = ["activated", "requested", "resolved", "stale", "ignored"]
    assert [[r.outcome for r in sorted((r for r in got if r.worker == w), key=lambda r: r.seq)] for w in (1, None)] == [want, want]
