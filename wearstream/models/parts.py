"""Parts of pipelines that Spark's library lacks: exact preparation, kernel features, and softmax boosting that stops early."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearstream.streaming.runs import kept as kept_rows


class Settings(Params, DefaultParamsReadable, DefaultParamsWritable):
    """One JSON parameter that holds all settings of a part, so that it is saved and loaded with its pipeline."""

    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)

    def given(self, **values):
        return self._set(settings=json.dumps(values))

    @property
    def of(self) -> dict:
        return json.loads(self.getOrDefault(self.settings))


class Prepared(Settings, Transformer):
    """Numbers to a vector: nulls and NaN by the training median, then centred and scaled where asked."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        s = self.of

        def one(c: str) -> Column:
            x = F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(s["fill"][c])), F.lit(s["fill"][c]))
            return (x - s["moments"][c][0]) / s["moments"][c][1] if s["scaled"] else x

        return rows.withColumn(s["out"], array_to_vector(F.array(*[one(c) for c in s["columns"]])))


class Preparation(Settings, Estimator):
    """Fits `Prepared` by exact medians and population deviations of the training rows."""

    def _fit(self, rows: DataFrame) -> Prepared:
        from wearstream.models.training import training_moments

        s = self.of
        known = rows.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in s["columns"]})
        fill, moments = training_moments(known, s["columns"])
        return Prepared().given(columns=s["columns"], out=s["out"], scaled=s["scaled"], fill=fill, moments=moments)


class FourierFeatures(Settings, Transformer):
    """Random Fourier features: their inner products approach the kernel exp(-gamma |x - y|^2), so a linear machine on them is a kernel one."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        s = self.of
        size, gamma, seed = s["size"], s["gamma"], s["seed"]

        @F.pandas_udf("array<double>")
        def waves(x: pd.Series) -> pd.Series:
            table = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
            rng = np.random.default_rng(seed)
            turn = rng.normal(0, np.sqrt(2 * gamma), (table.shape[1], size))
            shift = rng.uniform(0, 2 * np.pi, size)
            return pd.Series(list(np.sqrt(2 / size) * np.cos(table @ turn + shift)))

        return rows.withColumn(s["out"], array_to_vector(waves(vector_to_array(s["inp"]))))


class PolynomialFeatures(Settings, Transformer):
    """Tensor sketches of (gamma x.y + 1) ** degree: count sketches of each factor, multiplied by fast Fourier transforms."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        s = self.of
        size, gamma, degree, seed = s["size"], s["gamma"], s["degree"], s["seed"]

        @F.pandas_udf("array<double>")
        def sketches(x: pd.Series) -> pd.Series:
            table = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
            table = np.hstack([np.sqrt(gamma) * table, np.ones((len(table), 1))])
            rng, out = np.random.default_rng(seed), np.ones((len(table), size), complex)
            for _ in range(degree):
                place, sign = rng.integers(0, size, table.shape[1]), rng.choice([-1.0, 1.0], table.shape[1])
                one = np.zeros((len(table), size))
                np.add.at(one.T, place, (table * sign).T)
                out *= np.fft.fft(one, axis=1)
            return pd.Series(list(np.round(np.fft.ifft(out, axis=1).real, 12)))  # what is nothing but rounding is 0

        return rows.withColumn(s["out"], array_to_vector(sketches(vector_to_array(s["inp"]))))


def flat_tree(root) -> dict[str, list]:
    """A tree's nodes as lists: feature (-1 for a leaf), threshold, left, right, value."""
    out: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "v": []}

    def put(node) -> int:
        at, inner = len(out["f"]), node.getClass().getSimpleName() == "InternalNode"
        for name, x in (("f", -1), ("t", 0.0), ("l", at), ("r", at), ("v", float(node.prediction()))):
            out[name].append(x)
        if inner:
            out["f"][at], out["t"][at] = int(node.split().featureIndex()), float(node.split().threshold())
            out["l"][at], out["r"][at] = put(node.leftChild()), put(node.rightChild())
        return at

    put(root)
    return out


def grown(trees: list[dict], table: np.ndarray) -> np.ndarray:
    """The sum of some trees' values for each row."""
    total = np.zeros(len(table))
    for tree in trees:
        f, t, left, right, v = (np.array(tree[c]) for c in "ftlrv")
        at = np.zeros(len(table), np.int64)
        while (inner := f[at] >= 0).any():
            goes = table[np.arange(len(table)), np.maximum(f[at], 0)] <= t[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        total += v[at]
    return total


def margins(features: Column, rounds: list[list[dict]], start: list[float], rate: float) -> Column:
    """A row's margin for each class: where boosting starts, plus the rate times the trees' values."""

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        table = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
        by_class = [start[k] + rate * grown([r[k] for r in rounds], table) for k in range(len(start))]
        return pd.Series(list(np.stack(by_class, axis=1)))

    return score(vector_to_array(features))


def softmax(m: Column) -> Column:
    top = F.array_max(m)
    e = F.transform(m, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


class BoostedModel(Settings, Transformer):
    """Softmax-boosted trees: rawPrediction, probability and prediction."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        s = self.of
        scored = rows.withColumn("_m", margins(F.col(s["inp"]), s["rounds"], s["start"], s["rate"])).withColumn("_p", softmax(F.col("_m")))
        best = F.array_position("_p", F.array_max("_p")).cast("double") - 1.0
        return scored.withColumns({"rawPrediction": array_to_vector("_m"), "probability": array_to_vector("_p"), "prediction": best}).drop("_m", "_p")

    @property
    def n_rounds(self) -> int:
        return len(self.of["rounds"])


class SoftmaxBoosting(Settings, Estimator):
    """Boosting of one tree a class and round on the softmax loss, until rows kept for stopping haven't gained for some rounds.

    settings: inp, label, weight (columns), classes, rounds (most), depth, rate, patience, stop (a boolean column, or null: no
    early stopping). Margins are written to the shared folder each round, so a round reads the last one's and no more.
    """

    def _fit(self, rows: DataFrame) -> BoostedModel:
        s = self.of
        k, stop = s["classes"], F.col(s["stop"]) if s["stop"] else F.lit(False)
        kept = rows.select(F.col(s["inp"]).alias("x"), F.col(s["label"]).cast("int").alias("y"), F.col(s["weight"]).cast("double").alias("w"), F.coalesce(stop, F.lit(False)).alias("stop"))
        shares = {r.y: r.s for r in kept.where("not stop").groupBy("y").agg(F.sum("w").alias("s")).collect()}
        start = [float(np.log(max(shares.get(c, 0.0), 1e-9) / sum(shares.values()))) for c in range(k)]
        now = kept_rows(kept.withColumn("m", F.array(*[F.lit(x) for x in start])))
        found, best, since = [], (None, 0), 0
        for n in range(s["rounds"]):
            p = now.withColumn("p", softmax(F.col("m"))).where("not stop")
            trees = []
            for c in range(k):
                pull = p.withColumn("r", (F.col("y") == c).cast("double") - F.col("p")[c])
                fitted = DecisionTreeRegressor(featuresCol="x", labelCol="r", weightCol="w", maxDepth=s["depth"], seed=42).fit(pull)
                trees.append(flat_tree(fitted._java_obj.rootNode()))
            found.append(trees)
            step = margins(F.col("x"), [trees], [0.0] * k, s["rate"])
            now = kept_rows(now.withColumn("m", F.zip_with("m", step, lambda a, b: a + b)))
            if s["stop"]:
                loss = now.where("stop").agg((-F.avg(F.log(softmax(F.col("m"))[F.col("y")]))).alias("l")).first().l
                if loss is None or best[0] is None or loss < best[0] - 1e-6:
                    best, since = (loss, n + 1), 0
                else:
                    since += 1
                    if since >= s["patience"]:
                        break
        rounds = found[: best[1]] if s["stop"] and best[0] is not None else found
        return BoostedModel().given(inp=s["inp"], rounds=rounds, start=start, rate=s["rate"])
