"""A search of configurations with a ledger, so that a search that was stopped goes on where it ended."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearstream.models import training as M

SCHEMA = "key string, stage string, fold string, config string, converged boolean, matrix string"


def key_of(config: dict, fold: object) -> str:
    """The hash by which the ledger knows a configuration on a fold."""
    return hashlib.sha256(json.dumps([config, str(fold)], sort_keys=True).encode()).hexdigest()


class Ledger:
    """Rows (configuration, fold) with their confusion matrices, each written once it is done."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = {r.key: r.asDict() for r in self.table().collect()}  # as many as a search has fits

    def table(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(self.path).dropDuplicates(["key"])

    def put(self, row: dict) -> None:
        self.spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA).coalesce(1).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        self.rows[row["key"]] = row


def converged(model, params: dict) -> bool:
    """False for an iterative fit that used all its iterations."""
    last = model.stages[-1]
    parts = getattr(last, "models", [last])
    most = params.get("maxIter")
    done = [getattr(getattr(p, "summary", None), "totalIterations", None) if getattr(p, "hasSummary", False) else None for p in parts]
    return not any(most is not None and d is not None and d >= most for d in done)


def evaluated(ledger: Ledger, rows: DataFrame, folds: list[tuple], configs: list[dict], stage: str) -> list[dict]:
    """Each configuration (name, features, params, factors) with the pooled summary of its folds' predictions, and whether all converged.

    What the ledger holds isn't fitted again. Folds without two classes to learn are left out.
    """
    out = []
    for config in configs:
        matrices, good = [], True
        for fold, train, validation in folds:
            key = key_of(config, fold)
            if key not in ledger.rows:
                known = rows.where(train)
                if known.select("label").distinct().count() < 2:
                    continue
                factors = {int(k): v for k, v in (config.get("factors") or {}).items()}
                model = M.fit(known, config["name"], config["features"], config.get("params"), factors)
                counts = M.predict(model, rows.where(validation), config["features"]).groupBy("label", "predicted").count().collect()
                matrix = [[int(r["label"]), int(r["predicted"]), int(r["count"])] for r in counts]
                ledger.put({"key": key, "stage": stage, "fold": str(fold), "config": json.dumps(config, sort_keys=True), "converged": converged(model, config.get("params") or {}), "matrix": json.dumps(sorted(matrix))})
            row = ledger.rows[key]
            matrices.append(json.loads(row["matrix"]))
            good = good and row["converged"]
        if matrices:
            out.append({**config, "converged": good, **scores(ledger.spark, matrices)})
    return out


def scores(spark: SparkSession, matrices: list[list[list[int]]]) -> dict:
    """The summary of some confusion matrices (label, predicted, n) together."""
    total: dict[tuple[int, int], int] = {}
    for m in matrices:
        for label, said, n in m:
            total[label, said] = total.get((label, said), 0) + n
    long = spark.createDataFrame([(a, b, total.get((a, b), 0)) for a in range(3) for b in range(3)], "label int, predicted int, n long")
    return M.summary(long, "label", "predicted", [0, 1, 2], 2, 0).first().asDict()


def chosen(results: list[dict], score: str = "macro_f1", tolerance: float = 0.005, then: list[tuple[str, int]] = (("critical_recall", 1),)) -> dict:
    """The best result of those that converged (of all if none did): within tolerance of the best score, the best by the others."""
    pool = [r for r in results if r["converged"]] or results
    near = [r for r in pool if r[score] >= max(x[score] for x in pool) - tolerance]
    return max(near, key=lambda r: ([sign * (r.get(m) or 0.0) for m, sign in then], r[score], json.dumps(r["params"], sort_keys=True)))


def staged(ledger: Ledger, rows: DataFrame, folds: list[tuple], name: str, spaces: list[dict], weightings: list[dict], tune, margin: float = 0.01, feature_sets: dict[str, list[str]] = M.FEATURE_SETS) -> dict:
    """A frozen configuration, by stages: candidates over feature sets and weightings, the smallest set that holds up, tuning, freezing.

    spaces are the parameters to try; tune gives further parameters near a chosen configuration's. Every fit goes through the ledger.
    """
    candidates = [{"name": name, "set": s, "features": columns, "params": p, "factors": {str(k): v for k, v in w.items()}} for s, columns in feature_sets.items() for p in spaces for w in weightings]
    results = evaluated(ledger, rows, folds, candidates, "candidate")
    by_set = {s: chosen([r for r in results if r["set"] == s]) for s in feature_sets if any(r["set"] == s for r in results)}
    keep = M.parsimonious({s: r["macro_f1"] for s, r in by_set.items()}, list(by_set), margin)
    first = by_set[keep]
    base = {c: first[c] for c in ("name", "set", "features", "params", "factors")}
    tuned = evaluated(ledger, rows, folds, [base, *({**base, "params": p} for p in tune(base["params"]))], "tune")
    best = chosen(tuned)
    return M.frozen({c: best[c] for c in ("name", "set", "features", "params", "factors")} | {"scores": {m: round(best[m], 12) for m in ("macro_f1", "accuracy")}})
