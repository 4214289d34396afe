"""Training and selection of classifiers on pyspark.ml: feature sets, weights, folds, search, evaluation, promotion."""

from __future__ import annotations

import hashlib
import json
import random
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearstream.models import parts as P
from wearstream.operators.aggregates import confusion
from wearstream.operators.evaluation import summary
from wearstream.operators.quantiles import quantiles
from wearstream.operators.scans import numbered

#: The features in the order of the contract; each set contains the one before.
RAW = ["ambient_temperature", "uv_index", "gas", "noise", "body_temperature", "heart_rate"]
DEVIATIONS = ["hr_deviation_bpm", "hr_deviation_pct", "body_temp_deviation_c", "body_temp_deviation_pct"]
RATIO = ["gas_ratio_to_baseline"]
ROLLING = [
    "heart_rate_rolling_mean_30s", "heart_rate_rolling_mean_60s", "heart_rate_rolling_std_60s", "body_temp_rolling_mean_300s",
    "ambient_temp_rolling_mean_300s", "uv_rolling_mean_300s", "gas_rolling_mean_30s", "noise_rolling_mean_60s",
]
TRENDS = [
    "hr_trend_60s_bpm_per_min", "body_temp_trend_300s_c_per_min", "ambient_temp_trend_300s_c_per_min", "uv_trend_300s_per_min", "gas_trend_60s_per_min", "noise_trend_60s_db_per_min",
]
DOSE = ["noise_dose_pct"]
EXPOSURE = [f"{c}_{level}_exposure_sec" for c in ("temp", "uv", "gas", "noise", "hr", "body_temp") for level in ("warning", "critical")]
FEATURE_SETS = {"BASIC": RAW + DEVIATIONS + RATIO, "TEMPORAL": RAW + DEVIATIONS + RATIO + ROLLING + TRENDS + DOSE, "EXTENDED": RAW + DEVIATIONS + RATIO + ROLLING + TRENDS + DOSE + EXPOSURE}
CLASSES = ["Critical", "Safe", "Warning"]


def check_contract(rows: DataFrame, columns: list[str]) -> None:
    """Raises unless all features are there as numbers."""
    kinds = dict(rows.dtypes)
    missing = [c for c in columns if c not in kinds]
    wrong = [c for c in columns if c in kinds and kinds[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if missing or wrong:
        raise ValueError(f"missing features {missing}, not numbers {wrong}")


def standardised(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with nulls replaced by the training medians, then centred and scaled by the training rows' deviations.

    Exact medians; deviations are the population's; a column that doesn't vary is only centred.
    """
    fill, moments = training_moments(train, columns)
    out = {c: (F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) - moments[c][0]) / moments[c][1] for c in columns}
    return rows.withColumns(out)


def training_moments(train: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Each column's exact median, and mean and population deviation once nulls are filled by it; numbers for each of a few columns.

    All medians come from one pass over the columns' counted values. A column without values has the median 0, one that
    doesn't vary the deviation 1.
    """
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "value")
    fill = dict.fromkeys(columns, 0.0) | {r["name"]: r["q"][0] for r in quantiles(long, ["name"], "value", [0.5]).collect()}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in columns]
    one = train.agg(*[x for v, c in zip(filled, columns) for x in (F.avg(v).alias(f"m_{c}"), F.stddev_pop(v).alias(f"d_{c}"))]).first()
    return fill, {c: (one[f"m_{c}"] or 0.0, one[f"d_{c}"] or 1.0) for c in columns}


def with_weights(rows: DataFrame, label: str, factors: dict | None = None, balanced: bool = True) -> DataFrame:
    """rows with weight: inverse class frequency if balanced, times the class's factor, scaled to mean 1."""
    counts = rows.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("_n"))
    factor = F.lit(1.0)
    for c, f in (factors or {}).items():
        factor = F.when(F.col("_class") == c, float(f)).otherwise(factor)
    raw = (F.sum("_n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_n")) if balanced else F.lit(1.0)) * factor
    each = counts.withColumn("_raw", raw)  # a row per class
    total = F.sum(F.col("_raw") * F.col("_n")).over(Window.partitionBy()) / F.sum("_n").over(Window.partitionBy())
    each = each.select("_class", (F.col("_raw") / total).alias("weight"))
    return rows.join(F.broadcast(each), F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def worker_folds(rows: DataFrame) -> list[tuple[object, Column, Column]]:
    """(worker, training rows, validation rows) with each worker held out once; workers are few."""
    return [(w, F.col("worker") != w, F.col("worker") == w) for (w,) in sorted(rows.select("worker").distinct().collect())]


def with_blocks(rows: DataFrame, order: list[str], blocks: int, purge: int) -> DataFrame:
    """Chronological folds of each worker: block, and purged_from: the other blocks whose training leaves the row out.

    The rows are cut into contiguous blocks; a row within purge rows of another block's edge isn't trained on for it.
    """
    rows = _counted(numbered(rows, "worker", order, "_i"), "worker", "_n")
    edge = lambda k: F.floor(F.lit(k) * F.col("_n") / blocks)
    inside = [(F.col("_i") >= edge(k)) & (F.col("_i") < edge(k + 1)) for k in range(blocks)]
    near = [(F.col("_i") >= edge(k) - purge) & (F.col("_i") < edge(k + 1) + purge) & ~inside[k] for k in range(blocks)]
    block = F.coalesce(*[F.when(x, k) for k, x in enumerate(inside)])
    purged = F.filter(F.array(*[F.when(x, k) for k, x in enumerate(near)]), lambda x: x.isNotNull())
    return rows.withColumn("block", block).withColumn("purged_from", purged).drop("_i", "_n")


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the number of the key's rows."""
    counts = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(name))
    return rows.join(counts, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def with_stopping_split(rows: DataFrame, order: list[str], block: int = 300, every: int = 7, purge: int = 60) -> DataFrame:
    """rows with part: 'stop' for the middle one of each every blocks of a worker's rows, 'purged' for the rows next to one, else 'fit'."""
    rows = _counted(numbered(rows, "worker", order, "_i"), "worker", "_n").withColumn("_b", F.floor(F.col("_i") / block))
    at, stops = F.col("_i") - F.col("_b") * block, lambda b: F.pmod(b, F.lit(every)) == every // 2
    last = F.floor((F.col("_n") - 1) / block)
    near = ((at < purge) & (F.col("_b") > 0) & stops(F.col("_b") - 1)) | ((at >= block - purge) & stops(F.col("_b") + 1) & (F.col("_b") < last))
    return rows.withColumn("part", F.when(stops(F.col("_b")), "stop").when(near, "purged").otherwise("fit")).drop("_i", "_b", "_n")


def split(rows: DataFrame, label: str, key: str, seed: int, share: float = 0.2) -> DataFrame:
    """rows with test: the share of each class with the smallest hashes of seed and key (a whole number), rounded; others train.

    Hashes are counted by class, so no class is in one place; ties go by key.
    """
    hashed = rows.withColumn("_h", F.pmod(F.col(key).cast("long") * 2654435761 + seed * 40503, F.lit(1 << 32)))
    placed = _counted(numbered(hashed, label, ["_h", key], "_i"), label, "_n")
    return placed.withColumn("test", F.col("_i") < F.floor(F.col("_n") * share + 0.5)).drop("_h", "_i", "_n")


def configurations(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """n different settings of a grid, or all if it has fewer; the same for one seed."""
    every = [dict(zip(space, x)) for x in product(*space.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def stratified(spaces: dict[str, tuple[dict[str, list], int]], seed: int) -> list[dict]:
    """As many settings of each part of a search as it asks for."""
    return [{"kind": k, **c} for k, (space, n) in spaces.items() for c in configurations(space, n, seed)]


def estimator(name: str, columns: list[str], params: dict | None = None, classes: int = 3) -> Pipeline:
    """A pipeline from features to prediction: exact medians, scaling where the algorithm needs it, and the classifier.

    label is 0, 1, 2; weight is used where the algorithm takes it. Boosted Trees and SVM are one-vs-rest; SVM with kernel
    'rbf' or 'poly' (gamma, degree, size: features of its approximation) is a linear machine on kernel features; Softmax
    Boosting has all classes in one, and stops early by a boolean column named by stop.
    """
    params = dict(params or {})
    scaled = name in ("Logistic Regression", "SVM")
    steps, features = [P.Preparation().given(columns=columns, out="_features", scaled=scaled)], "_features"
    common = {"featuresCol": features, "labelCol": "label", "weightCol": "weight"}
    if name == "Logistic Regression":
        model = LogisticRegression(**common, **params)
    elif name == "Random Forest":
        model = RandomForestClassifier(**common, seed=42, **params)
    elif name == "Boosted Trees":
        model = OneVsRest(classifier=GBTClassifier(**common, seed=42, **params), **common)
    elif name == "Softmax Boosting":
        kept = {"rounds": 50, "depth": 4, "rate": 0.3, "patience": 5, "stop": None} | params
        model = P.SoftmaxBoosting().given(inp=features, label="label", weight="weight", classes=classes, **kept)
    elif name == "SVM":
        kernel, gamma = params.pop("kernel", "linear"), params.pop("gamma", 1.0 / len(columns))
        size, degree = params.pop("size", 256), params.pop("degree", 3)
        if kernel == "rbf":
            steps.append(P.FourierFeatures().given(inp=features, out="_kernel", size=size, gamma=gamma, seed=42))
        elif kernel == "poly":
            steps.append(P.PolynomialFeatures().given(inp=features, out="_kernel", size=size, gamma=gamma, degree=degree, seed=42))
        elif kernel != "linear":
            raise ValueError(f"no such kernel: {kernel}")
        common["featuresCol"] = features if kernel == "linear" else "_kernel"
        model = OneVsRest(classifier=LinearSVC(**common, **params), **common)
    else:
        raise ValueError(f"no such algorithm: {name}")
    return Pipeline(stages=[*steps, model])


def importances(model: PipelineModel, columns: list[str]) -> dict[str, float]:
    """A model's own importances of its features, summing to 1: of trees by gain, of linear models by absolute weights.

    Models of kernel features and softmax boosting have none by feature and raise.
    """
    last = model.stages[-1]
    parts = getattr(last, "models", [last])
    if any(type(s).__name__ in ("FourierFeatures", "PolynomialFeatures") for s in model.stages) or type(last).__name__ == "BoostedModel":
        raise ValueError("no importances by feature")
    total = np.zeros(len(columns))
    for p in parts:
        if hasattr(p, "featureImportances"):
            total += p.featureImportances.toArray()
        else:
            weights = p.coefficientMatrix.toArray() if hasattr(p, "coefficientMatrix") else p.coefficients.toArray()[None, :]
            total += np.abs(weights).sum(axis=0)
    return dict(zip(columns, (total / (total.sum() or 1.0)).tolist()))


def fit(train: DataFrame, name: str, columns: list[str], params: dict | None = None, factors: dict | None = None) -> PipelineModel:
    """A model of train's features and label (0, 1, 2), with balanced weights."""
    check_contract(train, columns)
    return estimator(name, columns, params).fit(with_weights(train.withColumns({c: F.col(c).cast("double") for c in columns}), "label", factors))


def predict(model: PipelineModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with predicted, and probabilities where the algorithm gives them (else null); missing features raise."""
    check_contract(rows, columns)
    out = model.transform(rows.withColumns({c: F.col(c).cast("double") for c in columns}))
    probabilities = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("predicted"), probabilities.alias("probabilities"))


def out_of_fold(rows: DataFrame, folds: list[tuple], name: str, columns: list[str], params: dict | None = None) -> DataFrame:
    """Predictions of each fold's validation rows by a model of its training rows, in one table with fold.

    A fold without training rows of two classes is left out, as nothing can be learnt.
    """
    parts = []
    for fold, train, validation in folds:
        known = rows.where(train)
        if known.select("label").distinct().count() > 1:
            parts.append(predict(fit(known, name, columns, params), rows.where(validation), columns).withColumn("fold", F.lit(fold)))
    if not parts:
        raise ValueError("no fold can be trained")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def pooled_scores(predictions: DataFrame, critical: int = 2, safe: int = 0) -> dict:
    """The summary of all folds' predictions together."""
    return summary(confusion(predictions, "label", "predicted", [0, 1, 2]), "label", "predicted", [0, 1, 2], critical, safe).first().asDict()


def parsimonious(best: dict[str, float], order: list[str], margin: float = 0.01) -> str:
    """The first feature set, from few to many features, that no later one beats by more than the margin."""
    chosen = order[0]
    for name in order[1:]:
        if best[name] > best[chosen] + margin:
            chosen = name
    return chosen


def frozen(config: dict) -> dict:
    """A configuration with its SHA-256, by which later steps know it unchanged."""
    text = json.dumps({k: v for k, v in config.items() if k != "sha256"}, sort_keys=True)
    return {**config, "sha256": hashlib.sha256(text.encode()).hexdigest()}


def promote(spark: SparkSession, model: PipelineModel, config: dict, scores: dict, expected: dict, path: str, tolerance: float = 1e-6) -> None:
    """Writes a model and its frozen configuration; raises if the configuration was changed or the scores aren't as expected."""
    if frozen(config) != config:
        raise ValueError("the configuration isn't the frozen one")
    off = {m: (scores.get(m), x) for m, x in expected.items() if scores.get(m) is None or abs(scores[m] - x) > tolerance}
    if off:
        raise ValueError(f"scores differ: {off}")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """A promoted model and its configuration, verified."""
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    if frozen(config) != config:
        raise ValueError("the configuration was changed")
    return PipelineModel.load(f"{path}/model"), config
