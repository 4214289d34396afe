"""Data-set profiles and model diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearstream.operators.quantiles import quantiles, running


def describe(rows: DataFrame, key: str, column: str, at: list[float]) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles by group."""
    one = rows.groupBy(key).agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"))
    q = quantiles(rows, [key], column, at).select(F.col(key).alias("_key"), *[F.round(F.col("q")[i], 6).alias(f"p{int(100 * x)}") for i, x in enumerate(at)])
    return one.join(q, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def inventory(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows, keys, first and last time, distinct minutes; nulls of every column. One pass."""
    return rows.agg(
        F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"), F.count_distinct(F.date_trunc("minute", ts)).alias("minutes"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in rows.columns],
    )


def correlations(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Pearson correlations of named pairs of columns; one pass."""
    return rows.agg(*[F.round(F.corr(a, b), 6).alias(name) for name, (a, b) in pairs.items()])


def conditional_shares(rows: DataFrame, given: Column, of: Column) -> DataFrame:
    """P(of | given) and P(given | of); null where the condition never holds."""
    share = lambda x, y: F.round(F.avg(F.when(y, x.cast("int"))), 6)
    return rows.agg(share(of, given).alias("of_given"), share(given, of).alias("given_of"))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and the named values of column, zero where there are none."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def confidence_table(rows: DataFrame, confidence: str, right: Column, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy at each threshold; one pass over the rows."""
    c = F.col(confidence)
    found = rows.agg(F.count("*").alias("n"), *[x for i, t in enumerate(thresholds) for x in (F.count_if(c >= t).alias(f"k{i}"), F.count_if((c >= t) & right).alias(f"r{i}"))])
    table = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.round(F.try_divide(f"k{i}", "n"), 6).alias("coverage"), F.round(F.try_divide(f"r{i}", f"k{i}"), 6).alias("accuracy")) for i, t in enumerate(thresholds)])
    return found.select(F.inline(table))


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve with ties at half, from counts by score; no window sees all of them."""
    by = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    ranked = running(by, [], "score", "q")
    return ranked.agg(F.round(F.try_divide(F.sum(F.col("p") * (F.col("_before") + F.col("q") / 2)), F.sum("p") * F.sum("q")), 6).alias("auc"))


def precision_at_recall(rows: DataFrame, score: str, positive: Column, recall: float) -> DataFrame:
    """The positives' score quantile that recalls a share of them, and the precision of all rows that reach it."""
    scored = rows.where(F.col(score).isNotNull()).select(F.col(score).alias("score"), positive.alias("positive"))
    threshold = quantiles(scored.where("positive"), [], "score", [round(1 - recall, 12)]).select(F.col("q")[0].alias("threshold"))
    reached = scored.crossJoin(F.broadcast(threshold)).where("score >= threshold")
    return reached.groupBy("threshold").agg(F.round(F.avg(F.col("positive").cast("int")), 6).alias("precision"))


def picked(rows: DataFrame, key: str, score: str, then: list[str], band: float) -> DataFrame:
    """The row that is best by the later measures among those within band of the best score; ties by key."""
    best = rows.agg(F.max(score).alias("best"))
    near = rows.crossJoin(F.broadcast(best)).where(F.col(score) >= F.col("best") - band - 1e-12)
    return near.orderBy(*[F.desc(c) for c in then], key).limit(1).select(key, score, *then)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows; size is kept within 1 to 100."""
    size = min(max(size, 1), 100)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    """Rows in all and the pages that they fill; size is kept within 1 to 100."""
    size = min(max(size, 1), 100)
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("pages"))
