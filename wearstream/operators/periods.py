"""Analytics of one calendar period, chosen by its kind and a date. The bounds are literals, so they prune the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearstream.functions import calendar as C
from wearstream.functions.scalars import half_up, percent_change, site_time


def bounds(rows: DataFrame, kind: str, date: str) -> dict:
    """The period's boundaries as values; a wrong kind or an impossible date raises."""
    if kind not in C.PERIODS:
        raise ValueError(f"no such period: {kind}")
    found = rows.sparkSession.range(1).select(C.checked_date(F.lit(date)).alias("day")).select("day", C.boundaries(F.lit(kind), F.col("day")).alias("b")).first()
    if found["day"] is None:
        raise ValueError(f"not a date: {date}")
    return found["b"].asDict()


def _inside(rows: DataFrame, start, end) -> DataFrame:
    return rows.where(C.within(F.col("ts"), F.lit(str(start)).cast("timestamp_ntz"), F.lit(str(end)).cast("timestamp_ntz")))


def in_period(rows: DataFrame, kind: str, date: str) -> DataFrame:
    """The rows of a period."""
    b = bounds(rows, kind, date)
    return _inside(rows, b["start"], b["end"])


def recent(rows: DataFrame, now: str, *, days: int, top: int) -> DataFrame:
    """The newest rows of the last days; ties by id."""
    end = F.lit(now).cast("timestamp_ntz")
    return rows.where(C.within(F.col("ts"), end - F.expr(f"interval '{days}' day"), end)).orderBy(F.desc("ts"), F.desc("event_id")).limit(top).select("event_id", "worker", "kind", "ts")


def activity(workers: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """How many workers there are, and how many distinct ones are in any of the sources."""
    seen = sources[0]
    for more in sources[1:]:
        seen = seen.union(more)
    active = seen.distinct().agg(F.count("worker").alias("active"))
    return workers.agg(F.count("*").alias("workers")).crossJoin(active)  # one row each


def channel_trend(rows: DataFrame, channels: list[str], kind: str, date: str) -> DataFrame:
    """Each channel's mean by bucket of a period; null in buckets without values."""
    spark = rows.sparkSession
    spine = spark.range(1).select(F.explode(C.buckets(F.lit(kind), F.lit(date).cast("date"))).alias("bucket")).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    long = in_period(rows, kind, date).select(C.bucket_of(F.lit(kind), F.col("ts")).alias("bucket"), *channels).unpivot(["bucket"], channels, "channel", "value")
    return F.broadcast(spine).join(long.groupBy("channel", "bucket").agg(F.round(F.avg("value"), 6).alias("mean")), ["channel", "bucket"], "left")


def critical_days(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Local days on which a channel reached its limit at least once; channels without such a day are left out."""
    day = site_time(F.col("ts")).cast("date").alias("day")
    hit = rows.select(day, *[F.when(F.col(c) >= limit, 1).alias(c) for c, limit in limits.items()])
    return hit.unpivot(["day"], list(limits), "channel", "hit").where("hit = 1").groupBy("channel").agg(F.count_distinct("day").alias("days"))


def comparison(rows: DataFrame, kind: str, date: str) -> DataFrame:
    """Alerts and the mean value of a period and of the one before, with the change in percent; one scan of both.

    The present mean has one digit, the earlier one is as it is.
    """
    b = bounds(rows, kind, date)
    both = _inside(rows, b["previous_start"], b["end"])
    now = F.col("ts") >= F.lit(str(b["start"])).cast("timestamp_ntz")
    of = lambda k, when: F.count_if(when & (F.col("kind") == k)).cast("double")
    one = both.agg(*[x for name, k in (("warnings", "WARNING"), ("criticals", "CRITICAL")) for x in (of(k, now).alias(f"{name}_now"), of(k, ~now).alias(f"{name}_before"))],
                   half_up(F.avg(F.when(now, F.col("value"))), 1).alias("mean_value_now"), F.round(F.avg(F.when(~now, F.col("value"))), 6).alias("mean_value_before"))
    rows_of = [F.struct(F.lit(m).alias("measure"), F.col(f"{m}_now").alias("now"), F.col(f"{m}_before").alias("before")) for m in ("warnings", "criticals", "mean_value")]
    return one.select(F.inline(F.array(*rows_of))).withColumn("change", percent_change(F.col("now"), F.col("before")))
