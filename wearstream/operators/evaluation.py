"""Evaluation of classifiers from counts: summaries, comparisons of experiments, outcomes, centroids, rankings."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearstream.operators.quantiles import quantiles, spearman


def summary(matrix: DataFrame, truth: str, said: str, classes: list, critical, safe) -> DataFrame:
    """One row from a confusion matrix (truth, said, n): accuracy, balanced accuracy, macro and weighted scores, critical misses.

    Macro scores are over the classes that the truth has; a score without a denominator is 0, a critical rate without
    critical rows null.
    """
    n = F.col("n")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    t, p = F.col(truth), F.col(said)
    parts = {}
    for i, c in enumerate(classes):
        parts |= {f"_s{i}": count(t == c), f"_p{i}": count(p == c), f"_h{i}": count((t == c) & (p == c))}
    one = matrix.agg(F.sum("n").alias("_n"), count((t == critical) & (p == safe)).alias("_miss"), *[x.alias(k) for k, x in parts.items()])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s, named, hit = ([F.col(f"_{k}{i}") for i in range(len(classes))] for k in "sph")
    precision, recall = [ratio(h, x) for h, x in zip(hit, named)], [ratio(h, x) for h, x in zip(hit, s)]
    f1 = [ratio(2 * a * b, a + b) for a, b in zip(precision, recall)]
    present = sum((F.when(x > 0, 1).otherwise(0) for x in s), F.lit(0))
    macro = lambda scores: ratio(sum((F.when(x > 0, v).otherwise(0.0) for x, v in zip(s, scores)), F.lit(0.0)), present)
    i = classes.index(critical)
    out = {
        "accuracy": ratio(sum(hit, F.lit(0)), F.col("_n")), "balanced_accuracy": macro(recall), "macro_precision": macro(precision), "macro_recall": macro(recall), "macro_f1": macro(f1),
        "weighted_f1": ratio(sum((x * v for x, v in zip(s, f1)), F.lit(0.0)), F.col("_n")), "critical_recall": F.when(s[i] > 0, recall[i]),
        "critical_fnr": F.when(s[i] > 0, 1 - recall[i]), "critical_to_safe": F.when(s[i] > 0, F.col("_miss") / s[i]),
    }
    return one.select(F.col("_n").alias("n"), *[F.round(x, 6).alias(k) for k, x in out.items()])


def means(results: DataFrame, by: str, measures: list[str]) -> DataFrame:
    return results.groupBy(by).agg(*[F.round(F.avg(m), 6).alias(m) for m in measures])


def wins(results: DataFrame, by: str, within: str, measure: str) -> DataFrame:
    """How often each value of by has the best measure within a group; ties go to the smallest."""
    best = results.groupBy(within).agg(F.min_by(by, F.struct(-F.col(measure), F.col(by))).alias(by))
    return best.groupBy(by).agg(F.count("*").alias("wins"))


def critical_outcomes(rows: DataFrame, by: list[str], truth: Column, said: Column, probability: Column) -> DataFrame:
    """Of critical rows: how many there are, were caught, taken for warnings or safe, and their mean critical probability."""
    return rows.where(truth == "CRITICAL").groupBy(*by).agg(
        F.count("*").alias("critical"), F.count_if(said == "CRITICAL").alias("caught"), F.count_if(said == "WARNING").alias("to_warning"), F.count_if(said == "SAFE").alias("to_safe"),
        F.round(F.avg(probability), 6).alias("mean_probability"),
    )


def shares(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """The share of rows for which each flag holds; null flags count as not."""
    return rows.groupBy(by).agg(*[F.round(F.avg(F.coalesce(f, F.lit(False)).cast("int")), 6).alias(n) for n, f in flags.items()])


def nearest_centroid(train: DataFrame, rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """rows with the label whose centroid is nearest, in the space standardised by train; ties go to the smallest label.

    Nulls are taken as the mean. There is one row of centroids per label, of which all rows get the list.
    """
    moments = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_d_{c}"))])
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}"), F.lit(0.0))
    centres = train.crossJoin(F.broadcast(moments)).groupBy(label).agg(F.array(*[F.avg(z(c)) for c in columns]).alias("at"))
    every = centres.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "at"))).alias("_centres"))
    own = F.array(*[z(c) for c in columns])
    far = lambda k: F.aggregate(F.zip_with(k["at"], F.col("_own"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    found = rows.crossJoin(F.broadcast(moments)).crossJoin(F.broadcast(every)).withColumn("_own", own)
    nearest = F.array_min(F.transform("_centres", lambda k: F.struct(F.round(far(k), 9).alias("d"), k["label"].alias("label"))))["label"]
    return found.select(*rows.columns, nearest.alias("nearest"))


def outside_range(rows: DataFrame, reference: DataFrame, columns: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """The columns whose median in rows is outside the reference's quantiles: name, median, low, high."""
    long = lambda t: t.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "v")
    mid = quantiles(long(rows), ["name"], "v", [0.5]).select("name", F.round(F.col("q")[0], 6).alias("median"))
    span = quantiles(long(reference), ["name"], "v", [low, high]).select(F.col("name").alias("_name"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))
    return mid.join(span, F.col("name") == F.col("_name")).where("median < low or median > high").drop("_name")


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.round(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int")), 6).alias("agreement"))


def standing(results: DataFrame, chosen: Column, measures: list[str]) -> DataFrame:
    """The chosen result's rank by each measure (1 + those above it) and its distance from the best."""
    one = results.where(chosen).select(*[F.col(m).alias(f"_{m}") for m in measures])
    parts = [x for m in measures for x in ((F.count_if(F.col(m) > F.col(f"_{m}")) + 1).alias(f"{m}_rank"), F.round(F.max(F.col(m)) - F.first(f"_{m}"), 6).alias(f"{m}_gap"))]
    return results.crossJoin(F.broadcast(one)).agg(*parts)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("value")).agg(F.count("*").alias("n"))


def rank_shift(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two results and their mean absolute difference."""
    return spearman(rows, a, b).crossJoin(rows.agg(F.round(F.avg(F.abs(F.col(a) - F.col(b))), 6).alias("mean_change")))  # one row each


def same_settings(a: DataFrame, b: DataFrame, keys: list[str], settings: str, kind: str) -> DataFrame:
    """For results in both tables: whether their JSON settings say the same."""
    parsed = lambda c: F.from_json(c, kind)
    other = b.select(*keys, F.col(settings).alias("_other"))
    return a.join(other, keys).select(*keys, parsed(F.col(settings)).eqNullSafe(parsed(F.col("_other"))).alias("same"))


def first_by_severity(rows: DataFrame, key: str, rank: Column, order: str, top: int) -> DataFrame:
    """Each key's top rows by rank, equal ones in their order."""
    w = Window.partitionBy(key).orderBy(rank.desc(), F.col(order))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def ranked_with_ties(candidates: list[dict], score: str, tolerance: float, then: list[tuple[str, int]]) -> list[dict]:
    """Best first: of those within tolerance of the best score left, the best by the other measures (sign 1: large is good).

    For a short list of results, which the driver holds; each pick looks at those that are left. Missing measures are 0.
    """
    left, out = list(candidates), []
    while left:
        best = max(c[score] for c in left)
        near = [c for c in left if c[score] >= best - tolerance]
        out.append(min(near, key=lambda c: [-sign * (c.get(m) or 0.0) for m, sign in then] + [-c[score]]))
        left.remove(out[-1])
    return out


def distributed_ranks(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their rank from 0 by key (ties: arbitrary), by sorted partitions' sizes; the same at every partitioning.

    Sorted rows are written to the shared folder first, so that their partitions stay as they were counted.
    """
    from wearstream.streaming.runs import shared_dir

    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/ranks-{uuid.uuid4().hex}"
    parted = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    parted.write.parquet(path)
    kept = spark.read.schema(parted.schema).parquet(path).withColumn("_p", F.shiftright("_m", 33))
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_p").alias("_q"), before.alias("_before"))
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).withColumn(name, F.col("_before") + local).drop("_m", "_p", "_q", "_before")


def feistel(ranks: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """A seeded permutation of 0 to n - 1 at some ranks: a Feistel network over the next even number of bits, walked until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, rng = np.uint64((1 << half) - 1), np.random.default_rng(seed)
    keys = rng.integers(1, 1 << 63, rounds).astype(np.uint64) | np.uint64(1)
    out, todo = ranks.astype(np.uint64), np.ones(len(ranks), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * k
            left, right = right, left ^ ((mixed >> np.uint64(31)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def shuffled(rows: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """rows with a column's values dealt out anew among all rows; the same for one seed, whatever the partitions.

    Ranks by key are permuted by a bijection, row by row, and the values come by a join on the rank: nothing is sorted
    but by key, and no bucket holds a share of the rows. keys should be distinct.
    """
    ranked = distributed_ranks(rows, key, "_rank")
    n = ranked.count()

    @F.pandas_udf("long")
    def target(r: pd.Series) -> pd.Series:
        return pd.Series(feistel(r.to_numpy(), n, seed))

    given = ranked.select(F.col("_rank").alias("_from"), F.col(column).alias("_given"))
    taken = ranked.drop(column).withColumn("_to", target("_rank")).join(given, F.col("_to") == F.col("_from"))
    return taken.select(*[F.col("_given").alias(column) if c == column else c for c in rows.columns])


def permutation_importance(rows: DataFrame, key: str, columns: list[str], score, repeats: int = 3, seed: int = 42) -> dict[str, tuple[float, float]]:
    """How far score(rows) falls, by mean and deviation, when a column is shuffled; score gives a number for a table."""
    base, out = score(rows), {}
    for c in columns:
        drops = [base - score(shuffled(rows, key, c, seed + 1000 * r)) for r in range(repeats)]
        mean = sum(drops) / repeats
        out[c] = (mean, (sum((x - mean) ** 2 for x in drops) / repeats) ** 0.5)
    return out
