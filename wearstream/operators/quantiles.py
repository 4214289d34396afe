"""Exact order statistics without a group's values in one place.

Rows are counted by value first. A key's values are dealt to pieces at approximate quantiles, and running counts come from
sums within the pieces and over the pieces' totals, of which a key has at most PIECES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64


def running(counts: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """counts (a row per key and value) with _before: the sum of weight over the key's smaller values."""
    bounds = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.percentile_approx(value, [i / PIECES for i in range(1, PIECES)], 1000).alias("_bounds"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = counts.join(bounds, same) if same else counts.crossJoin(bounds)  # one row
    dealt = joined.select(*counts.columns, F.size(F.filter("_bounds", lambda b: b < F.col(value))).alias("_piece"))
    totals = dealt.groupBy(*keys, "_piece").agg(F.sum(weight).alias("_total"))
    below = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_piece").alias("_p"), F.coalesce(below, F.lit(0)).alias("_below"))
    inside = F.sum(weight).over(Window.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    at = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_piece") == F.col("_p")]
    found = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(totals, at)
    return found.select(*counts.columns, (F.col("_below") + F.col("_inside")).alias("_before"))


def quantiles(rows: DataFrame, keys: list[str], column: str, at: list[float]) -> DataFrame:
    """For each key an array q of exact quantiles with linear interpolation; keys without values are left out."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running(counts, keys, "_v", "_n")
    size = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("_n").alias("_size"))
    sized = ranked.join(size, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else ranked.crossJoin(size)

    def ranked_at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v")))

    parts = []
    for i, q in enumerate(at):
        place = (F.col("_size") - 1) * F.lit(float(q))
        parts += [ranked_at(F.floor(place)).alias(f"_lo{i}"), ranked_at(F.ceil(place)).alias(f"_hi{i}"), F.first(place - F.floor(place)).alias(f"_f{i}")]
    found = sized.groupBy(*keys).agg(*parts)
    mix = lambda i: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")
    return found.select(*keys, F.array(*[mix(i) for i in range(len(at))]).alias("q"))


def mean_ranks(rows: DataFrame, column: str) -> DataFrame:
    """Each value of a column with its mean rank among the rows: value, rank."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running(counts, [], "value", "n").select("value", (F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns over the rows that have both."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    ra, rb = (mean_ranks(both, c).select(F.col("value").alias(f"{c}_v"), F.col("rank").alias(f"{c}_r")) for c in ("_a", "_b"))
    ranked = both.join(ra, F.col("_a") == F.col("_a_v")).join(rb, F.col("_b") == F.col("_b_v"))
    return ranked.agg(F.round(F.corr("_a_r", "_b_r"), 6).alias("spearman"))
