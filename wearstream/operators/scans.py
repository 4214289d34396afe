"""Scans along a worker's time without a worker's rows in one place.

Rows are dealt to slices of time. Windows see one slice of one worker; what a slice hands on (its last row, its sums, its last
value) is one row, and what comes before a slice is found over those rows and handed back. So a task holds a slice's
rows, or one row for each slice of a worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wearstream.operators.quantiles import running

SECOND = 1_000_000
#: Seconds of a slice: at one row a second a task holds so many rows of a worker.
SLICE_SECONDS = 6 * 3600


def in_slices(rows: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """rows (worker, us) with _slice; rows without a time are a slice before all others."""
    return rows.withColumn("_slice", F.coalesce(F.floor(F.col("us") / (seconds * SECOND)), F.lit(-(1 << 62))))


def here(order: list[str]) -> WindowSpec:
    return Window.partitionBy("worker", "_slice").orderBy(*order)


def earlier() -> WindowSpec:
    """Over the slices' rows: the slices before."""
    return Window.partitionBy("worker").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def handed(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """rows with what their slice was handed, by worker and slice."""
    named = summaries.withColumnsRenamed({"worker": "_w", "_slice": "_s"})
    return rows.join(named, F.col("worker").eqNullSafe(F.col("_w")) & (F.col("_slice") == F.col("_s")), "left").drop("_w", "_s")


def with_previous(rows: DataFrame, columns: list[str], order: list[str], name: str = "previous") -> DataFrame:
    """rows with a struct of the columns of the worker's row before in order; null for its first. order begins with us."""
    one = F.struct(*columns)
    ends = rows.groupBy("worker", "_slice").agg(F.max_by(one, F.struct(*order)).alias("_end"))
    carry = ends.select("worker", "_slice", F.last("_end").over(earlier()).alias("_carry"))
    return handed(rows.withColumn(name, F.lag(one).over(here(order))), carry).withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def with_running(rows: DataFrame, sums: dict[str, Column], order: list[str]) -> DataFrame:
    """rows with running sums of whole numbers over the worker's rows up to each."""
    w = here(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("worker", "_slice").agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    carry = totals.select("worker", "_slice", *[F.coalesce(F.sum(c).over(earlier()), F.lit(0)).alias(f"_before_{c}") for c in sums])
    local = handed(rows.withColumns({c: F.sum(x).over(w) for c, x in sums.items()}), carry)
    return local.withColumns({c: F.col(c) + F.col(f"_before_{c}") for c in sums}).drop(*[f"_before_{c}" for c in sums])


def with_last(rows: DataFrame, value: Column, name: str, order: list[str]) -> DataFrame:
    """rows with the last value that isn't null among the worker's rows up to each."""
    w = here(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_value", value)
    ends = marked.groupBy("worker", "_slice").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    carry = ends.select("worker", "_slice", F.last("_end", ignorenulls=True).over(earlier()).alias("_carry"))
    local = handed(marked.withColumn(name, F.last("_value", ignorenulls=True).over(w)), carry)
    return local.withColumn(name, F.coalesce(name, "_carry")).drop("_carry", "_value")


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their place from 0 among the key's rows, in order of a number and, where it is equal, of the other columns.

    Places come from counts by value, so a key's rows are never in one place; only rows with one value are.
    """
    first, *ties = order
    counts = rows.groupBy(F.col(key).alias("_k"), F.col(first).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    before = running(counts, ["_k"], "_v", "_n").withColumnRenamed("_before", "_at")
    same = Window.partitionBy(key, first).orderBy(*(ties or [first]))
    joined = rows.withColumn("_tie", F.row_number().over(same) - 1).join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col(first).cast("double").eqNullSafe(F.col("_v")))
    return joined.withColumn(name, F.col("_at") + F.col("_tie")).drop("_k", "_v", "_n", "_at", "_tie")
