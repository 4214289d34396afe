"""Period analytics over samples and alerts: counts, rankings, zero-filled trends, summaries, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearstream.functions.scalars import STATES, half_up, severity, site_time
from wearstream.operators.quantiles import quantiles


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Warnings, criticals, emergencies and their sum; one pass."""
    one = {k.lower(): F.count_if(F.col("kind") == k) for k in ("WARNING", "CRITICAL", "EMERGENCY")}
    return alerts.agg(*[c.alias(k) for k, c in one.items()]).withColumn("total", F.expr("warning + critical + emergency"))


def risk_trend(alerts: DataFrame, *, by: str) -> DataFrame:
    """Counts by local hour of the day or by local day, with empty buckets between the first and last at zero.

    The spine comes from the aggregate's bounds, so only buckets are broadcast or exploded, never rows.
    """
    local = site_time(F.col("ts"))
    bucket = F.hour(local) if by == "hour" else local.cast("date")
    counts = alerts.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("kind") == "WARNING").alias("warnings"), F.count_if(F.col("kind") == "CRITICAL").alias("criticals"))
    if by == "hour":
        spine = alerts.sparkSession.range(24).select(F.col("id").cast("int").alias("bucket"))
    else:
        spine = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z")).alias("bucket"))
    return spine.join(counts, "bucket", "left").na.fill(0, ["warnings", "criticals"])


def worker_ranking(alerts: DataFrame, workers: DataFrame, *, top: int) -> DataFrame:
    """The workers with most criticals, then emergencies, warnings, alerts; ties by id. With name and latest state."""
    ranked = alerts.groupBy("worker").agg(
        F.count_if(F.col("kind") == "CRITICAL").alias("criticals"), F.count_if(F.col("kind") == "EMERGENCY").alias("emergencies"), F.count_if(F.col("kind") == "WARNING").alias("warnings"),
        F.count("*").alias("alerts"), F.max_by("kind", F.struct("ts", "event_id")).alias("latest"),
    ).orderBy(F.desc("criticals"), F.desc("emergencies"), F.desc("warnings"), F.desc("alerts"), "worker").limit(top)
    return ranked.join(workers, ranked.worker == workers.worker_id, "left").select("worker", F.coalesce("name", F.col("worker").cast("string")).alias("name"), "criticals", "emergencies", "warnings", "alerts", "latest")


def channel_summary(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean, extremes, and shares of warnings and criticals for each channel: one unpivot, one group-by."""
    long = rows.select([F.col(c).cast("double").alias(c) for c in limits]).unpivot([], list(limits), "channel", "value").where("value is not null")
    level = lambda i: F.element_at(F.create_map(*[x for c, lim in limits.items() for x in (F.lit(c), F.lit(float(lim[i])))]), F.col("channel"))
    return long.withColumn("w", level(0)).withColumn("c", level(1)).groupBy("channel").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"),
        F.count_if((F.col("value") >= F.col("w")) & (F.col("value") < F.col("c"))).alias("warnings"), F.count_if(F.col("value") >= F.col("c")).alias("criticals"),
    ).withColumn("critical_percent", half_up(F.col("criticals") * 100.0 / F.col("n"), 1))


def extreme_deviation(rows: DataFrame, *, least: float) -> DataFrame:
    """Per worker: mean size of the deviation, the largest with its sign, and how often it reached a size."""
    d = F.col("deviation")
    return rows.where(d.isNotNull()).groupBy("worker").agg(
        F.round(F.avg(F.abs(d)), 6).alias("mean_size"), F.max(F.struct(F.abs(d).alias("size"), d.alias("signed")))["signed"].alias("extreme"), F.count_if(F.abs(d) >= least).alias("events")
    )


def largest_deviations(rows: DataFrame, *, top: int) -> DataFrame:
    """The workers with the largest deviation by size, which keeps its sign; of equal sizes the positive one, then by id."""
    d = F.col("deviation")
    best = rows.where(d.isNotNull()).groupBy("worker").agg(F.max(F.struct(F.abs(d).alias("size"), d.alias("deviation"))).alias("m"))
    return best.select("worker", "m.size", "m.deviation").orderBy(F.desc("size"), "worker").limit(top)


def daily_means(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Means by key and local day with the number of values; days without rows are left out."""
    return rows.groupBy(key, site_time(F.col("ts")).cast("date").alias("day")).agg(F.round(F.avg(column), 6).alias("mean"), F.count(column).alias("n"))


def longest_streaks(rows: DataFrame, counter: str, *, top: int) -> DataFrame:
    """The workers whose counter came furthest, above 0; ties by id. The counter runs, so its maximum counts, never its sum."""
    best = rows.groupBy("worker").agg(F.max(counter).alias("longest")).where("longest > 0")
    return best.orderBy(F.desc("longest"), "worker").limit(top)


def risky_hours(alerts: DataFrame, *, top: int) -> DataFrame:
    """Local hours with most criticals, then warnings; ties by hour."""
    return risk_trend(alerts, by="hour").where("warnings + criticals > 0").orderBy(F.desc("criticals"), F.desc("warnings"), "bucket").limit(top)


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values; the total comes from the counts, not from a second pass."""
    counts = rows.groupBy(column).count()
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, F.col("count").alias("n"), F.round(F.col("count") / F.col("total"), 6).alias("share"))


def group_quantiles(rows: DataFrame, key: str, column: str, at: list[float]) -> DataFrame:
    return quantiles(rows, [key], column, at).select(key, *[F.round(F.col("q")[i], 6).alias(f"q{int(100 * x)}") for i, x in enumerate(at)])


def mean_difference(rows: DataFrame, one: Column, other: Column, train: Column, columns: list[str]) -> DataFrame:
    """How far the mean of one part of the rows is from another's, in sample deviations of the training rows; null if they don't vary."""
    flags = {"_one": one, "_other": other, "_train": train}
    long = rows.select(*[f.alias(n) for n, f in flags.items()], *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(flags), columns, "channel", "value")
    of = lambda f: F.when(F.col(f), F.col("value"))
    return long.groupBy("channel").agg(F.round((F.avg(of("_one")) - F.avg(of("_other"))) / F.nullif(F.stddev_samp(of("_train")), F.lit(0.0)), 6).alias("smd"))


def largest_differences(differences: DataFrame, top: int) -> DataFrame:
    """The channels whose means differ most, either way; ties by name."""
    return differences.orderBy(F.abs("smd").desc_nulls_last(), "channel").limit(top)


def confusion(rows: DataFrame, truth: str, said: str, classes: list) -> DataFrame:
    """Counts for every pair of classes, zero where there is none; the spine has len(classes) squared rows."""
    one = rows.sparkSession.createDataFrame([(c, d) for c in classes for d in classes], f"{truth} int, {said} int")
    return F.broadcast(one).join(rows.groupBy(truth, said).count(), [truth, said], "left").select(truth, said, F.coalesce("count", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame, truth: str, said: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, from a confusion matrix."""
    hit = F.when(F.col(truth) == F.col(said), F.col("n")).otherwise(0)
    rec = matrix.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    pre = matrix.groupBy(F.col(said).alias("class")).agg(F.sum("n").alias("named"))
    p, r = F.coalesce(F.try_divide("hits", "named"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return rec.join(pre, "class").select("class", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def worst(state: Column) -> Column:
    """The most severe of a group's states."""
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), F.max(severity(state)) + 1)
