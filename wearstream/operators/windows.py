"""Rolling statistics and timelines per worker: range frames, islands and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearstream.operators.scans import SLICE_SECONDS, in_slices, with_last, with_previous, with_running

#: A slice of a worker's time is so many times as long as the window that looks back.
SLICE = 16


def sliced(rows: DataFrame, seconds: int) -> DataFrame:
    """The rows dealt to slices of time, each with copies (own false) of the last rows before it that a window of seconds needs.

    Windows over (worker, slice) then see what windows over the worker would, and no task has more than a slice of one.
    One row in SLICE is copied on average. Rows without a time keep a slice of their own.
    """
    size = SLICE * seconds * 1_000_000
    here = F.floor(F.col("us") / size)
    late = F.col("us") - here * size > size - seconds * 1_000_000
    both = F.when(late, F.array(here, here + 1)).otherwise(F.array(here))
    return rows.withColumn("_here", here).withColumn("slice", F.explode(both)).withColumn("own", F.col("slice").eqNullSafe(F.col("_here"))).drop("_here")


def owned(rows: DataFrame) -> DataFrame:
    return rows.where("own").drop("own", "slice")


def with_micros(rows: DataFrame) -> DataFrame:
    """Adds us: the sample's time in microseconds, which range frames need."""
    return rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def rolling(rows: DataFrame, seconds: int, least: int) -> DataFrame:
    """Mean and sample deviation over the last seconds; null with fewer than least values. Both share one sort of slices."""
    f = Window.partitionBy("worker", "slice").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    enough = F.count("value").over(f) >= least
    return owned(sliced(rows, seconds).withColumn("roll_mean", F.when(enough, F.avg("value").over(f))).withColumn("roll_std", F.when(enough, F.stddev_samp("value").over(f))))


def median_split(rows: DataFrame, seconds: int, part: int, least: int) -> DataFrame:
    """Change from the median of the window's first part to that of its last, per 60 units; null with few values."""
    w = Window.partitionBy("worker", "slice").orderBy("us")
    head, tail = w.rangeBetween(-(seconds * 1_000_000 - 1), -(seconds - part) * 1_000_000), w.rangeBetween(-(part * 1_000_000 - 1), 0)
    enough = (F.count("value").over(head) >= least) & (F.count("value").over(tail) >= least)
    change = F.percentile("value", 0.5).over(tail) - F.percentile("value", 0.5).over(head)
    return owned(sliced(rows, seconds).withColumn("trend", F.when(enough, change / (seconds - part) * 60)))


def exposure(rows: DataFrame, active: Column, bridge_seconds: int, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Seconds that a condition has held: 1 at its start, growing with time, 0 when it ends; gaps up to bridge_seconds count."""
    marked = with_previous(in_slices(rows.withColumn("active", F.coalesce(active, F.lit(False))), slice_seconds), ["us", "active"], ["us"])
    goes_on = F.coalesce(F.col("previous.active") & (F.col("us") - F.col("previous.us") <= bridge_seconds * 1_000_000), F.lit(False))
    began = with_last(marked, F.when(F.col("active") & ~goes_on, F.col("us")), "began", ["us"])
    return began.withColumn("exposure", F.when(F.col("active"), F.lit(1.0) + (F.col("us") - F.col("began")) / 1e6).otherwise(0.0)).drop("began", "previous", "_slice")


def held(rows: DataFrame, seconds: int) -> DataFrame:
    """The last accepted value while it is at most seconds old, and whether it was observed, held or is unavailable."""
    w = Window.partitionBy("worker", "slice").orderBy("us")
    v, at = F.last("value", ignorenulls=True).over(w), F.last(F.when(F.col("value").isNotNull(), F.col("us")), ignorenulls=True).over(w)
    fresh = F.col("us") - at <= seconds * 1_000_000
    origin = F.when(F.col("value").isNotNull(), "OBSERVED").when(fresh, "IMPUTED").otherwise("UNAVAILABLE")
    return owned(sliced(rows, seconds + 1).withColumn("held", F.when(fresh, v)).withColumn("origin", origin))


def sessions(rows: DataFrame, gap_seconds: int, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Numbers each worker's sessions from 0: a new one begins after a gap of more than gap_seconds."""
    order = ["us", "event_id"]
    before = with_previous(in_slices(rows, slice_seconds), ["us"], order)
    split = F.coalesce(F.col("us") - F.col("previous.us") > gap_seconds * 1_000_000, F.lit(False)).cast("int")
    return with_running(before, {"session": split}, order).drop("previous", "_slice")


def receipts(rows: DataFrame, seconds: int, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Samples received in the last seconds, and the samples since the last gap longer than that."""
    order = ["us", "event_id"]
    frame = Window.partitionBy("worker", "slice").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = owned(sliced(rows, seconds).withColumn("received", F.count("*").over(frame)))
    before = with_previous(in_slices(counted, slice_seconds), ["us"], order)
    placed = with_running(before, {"_place": F.lit(1)}, order)
    first = F.coalesce(F.col("us") - F.col("previous.us") > seconds * 1_000_000, F.col("previous").isNull())
    return with_last(placed, F.when(first, F.col("_place")), "_first", order).withColumn("since_gap", F.col("_place") - F.col("_first") + 1).drop("_place", "_first", "previous", "_slice")


def episodes(rows: DataFrame, active: Column, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Runs of rows for which active holds: worker, number of the run, rows."""
    order = ["us", "event_id"]
    marked = with_previous(in_slices(rows.withColumn("active", F.coalesce(active, F.lit(False))), slice_seconds), ["active"], order)
    rise = F.col("active") & ~F.coalesce(F.col("previous.active"), F.lit(False))
    runs = with_running(marked, {"episode": rise.cast("int")}, order)
    return runs.where("active").groupBy("worker", "episode").agg(F.count("*").alias("n"))
