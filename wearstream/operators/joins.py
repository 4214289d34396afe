"""Joins on ids: latest rows, duplicates, alignment, leaks, coverage. Sides are broadcast only where Spark's size estimate allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_wins(snapshot: DataFrame, live: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last of both tables. max_by combines before the shuffle, so a hot key is no hot task."""
    both = snapshot.unionByName(live)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def named(rows: DataFrame, workers: DataFrame) -> DataFrame:
    """Rows (worker, ...) with their worker's name, or the id where there is none."""
    joined = rows.join(workers.select(F.col("worker_id").alias("_w"), F.col("name").alias("_name")), F.col("worker") == F.col("_w"), "left")
    return joined.withColumn("name", F.coalesce("_name", F.col("worker").cast("string"))).drop("_w", "_name")


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key the others don't have."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def latest_state(rows: DataFrame, key: str, state: str) -> DataFrame:
    """Each key's last state and when it was; equal times by event_id."""
    return rows.groupBy(key).agg(F.max_by(state, F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("seen"))


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """All rows of the tables, by names; columns that a table lacks are null."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def unseen(batch: DataFrame, stored: DataFrame, keys: list[str], first: str) -> DataFrame:
    """The batch's rows whose keys aren't stored, of each key the one with the smallest first; null keys stay as one."""
    rest = [c for c in batch.columns if c not in keys]
    once = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(first)).alias("row")).select(*keys, "row.*")
    return once.join(stored.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)


def leaks(rows: DataFrame, training: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """The rows whose rounded values occur in training."""
    rounded = {f"r_{c}": F.round(c, digits) for c in columns}
    return rows.withColumns(rounded).join(training.select(*[x.alias(n) for n, x in rounded.items()]).distinct(), list(rounded), "left_semi").select(*rows.columns)


def state_counts(workers: DataFrame, states: DataFrame) -> DataFrame:
    """Workers in each state; those without one are UNKNOWN."""
    joined = workers.join(states, workers.worker_id == states.worker, "left")
    return joined.groupBy(F.coalesce("latest", F.lit("UNKNOWN")).alias("state")).agg(F.count("*").alias("workers"))


def parity(left: DataFrame, right: DataFrame, key: str, columns: list[str], tolerance: float) -> DataFrame:
    """For each column: rows compared and matching, largest difference, and rows where only one side is null."""
    a, b = (t.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "feature", v) for t, v in ((left, "a"), (right, "b")))
    d = F.abs(F.col("a") - F.col("b"))
    return a.join(b, [key, "feature"]).groupBy("feature").agg(
        F.count("*").alias("n"), F.count_if((d <= tolerance) | (F.col("a").isNull() & F.col("b").isNull())).alias("matching"),
        F.round(F.max(d), 6).alias("largest"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("one_null"),
    )
