"""The driver's tables as samples, alerts and workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearstream.functions.scalars import alert_kind

#: Channels of the line items with their warning and critical limits.
CHANNELS = {"l_quantity": (30, 45), "l_extendedprice": (30000, 50000), "l_discount": (0.05, 0.08), "l_tax": (0.04, 0.07)}
KIND_SQL = "CASE event_type WHEN 'click' THEN 'WARNING' WHEN 'purchase' THEN 'CRITICAL' WHEN 'error' THEN 'EMERGENCY' WHEN 'view' THEN 'SAFE' ELSE 'DATA_QUALITY' END"
ALERTS_SQL = f"a AS (SELECT event_id, user_id worker, ts, {KIND_SQL} kind FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("worker"), "ts", "value", "event_type")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("event_id", "worker", "ts", alert_kind(F.col("event_type")).alias("kind"))


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("worker_id"), F.col("c_name").alias("name"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers with two baselines."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("worker_id"), F.col("c_acctbal").alias("heart"), F.col("c_nationkey").cast("double").alias("body"))


def helmets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helmets, two in three of which have a wearer, with whether they are active and when they were registered."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("helmet"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") * 20).alias("wearer"), (F.col("s_acctbal") > 0).alias("active"),
        (start + F.make_dt_interval(hours=F.col("s_nationkey"))).alias("registered"),
    )
