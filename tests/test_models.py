import numpy as np
import pytest

from wearstream.models import training as M
from wearstream.operators import evaluation as E


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(360):
        label = int(rng.integers(0, 3))
        out.append((i, f"W_{i % 3}", float(label + rng.normal(0, 0.3)), None if i % 17 == 0 else float(rng.normal(0, 1)), 3 - label, label))
    return spark.createDataFrame(out, "id long, worker string, a double, b double, c int, label int").persist()


def test_feature_sets_are_nested():
    sizes = [len(s) for s in M.FEATURE_SETS.values()]
    basic, temporal, extended = map(set, M.FEATURE_SETS.values())
    assert sizes == [11, 26, 38] and basic < temporal < extended and len(extended) == 38


@pytest.mark.parametrize("name,params", [("Logistic Regression", {"maxIter": 20}), ("Random Forest", {"numTrees": 5}), ("Boosted Trees", {"maxIter": 3}), ("SVM", {"maxIter": 10})])
def test_algorithms_learn(rows, name, params):
    model = M.fit(rows, name, ["a", "b", "c"], params, {2: 2.0})
    found = M.predict(model, rows, ["a", "b", "c"])
    assert found.columns == [*rows.columns, "predicted", "probabilities"]
    got = found.collect()
    assert np.mean([r.predicted == r.label for r in got]) > 0.9
    if name == "Logistic Regression":
        assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in got)


def test_contracts(rows):
    with pytest.raises(ValueError, match="missing"):
        M.fit(rows, "Random Forest", ["a", "zzz"])
    with pytest.raises(ValueError, match="worker"):
        M.predict(None, rows, ["worker"])
    with pytest.raises(ValueError, match="algorithm"):
        M.estimator("Oracle", ["a"])


def test_out_of_fold_predictions_cover_every_worker_once(rows):
    folds = M.worker_folds(rows)
    assert [w for w, _, _ in folds] == ["W_0", "W_1", "W_2"]
    found = M.out_of_fold(rows, folds, "Logistic Regression", ["a", "c"], {"maxIter": 20})
    assert found.count() == 360 and found.select("id").distinct().count() == 360 and found.where("fold <> worker").count() == 0
    scores = M.pooled_scores(found)
    assert scores["n"] == 360 and scores["macro_f1"] > 0.9 and scores["critical_to_safe"] < 0.05
    with pytest.raises(ValueError):
        M.out_of_fold(rows.where("label = 1"), folds, "Logistic Regression", ["a"])


def test_search_is_seeded_and_stratified():
    space = {"x": [1, 2, 3], "y": [4, 5]}
    assert M.configurations(space, 4, 7) == M.configurations(space, 4, 7) and len(M.configurations(space, 99, 7)) == 6
    found = M.stratified({"l1": (space, 2), "l2": ({"x": [9]}, 3)}, 1)
    assert [c["kind"] for c in found] == ["l1", "l1", "l2"] and found[2] == {"kind": "l2", "x": 9}


def test_selection():
    assert M.parsimonious({"BASIC": 0.8, "TEMPORAL": 0.809, "EXTENDED": 0.815}, ["BASIC", "TEMPORAL", "EXTENDED"]) == "EXTENDED"
    assert M.parsimonious({"BASIC": 0.8, "TEMPORAL": 0.81, "EXTENDED": 0.805}, ["BASIC", "TEMPORAL", "EXTENDED"]) == "BASIC"
    results = [{"m": "a", "f": 0.90, "r": 0.5}, {"m": "b", "f": 0.897, "r": 0.9}, {"m": "c", "f": 0.893, "r": 0.99}, {"m": "d", "f": 0.5, "r": None}]
    assert [c["m"] for c in E.ranked_with_ties(results, "f", 0.005, [("r", 1)])] == ["b", "a", "c", "d"]


def test_split_is_stratified(rows):
    out = M.split(rows, "label", "id", 42).collect()
    for label in range(3):
        of = [r for r in out if r.label == label]
        assert sum(r.test for r in of) == int(len(of) * 0.2 + 0.5)


def test_permutation_importance_finds_what_matters(rows):
    model = M.fit(rows, "Logistic Regression", ["a", "b"], {"maxIter": 20})
    again = E.shuffled(rows, "id", "a", 1).collect()
    assert sorted(r.a for r in again) == sorted(r.a for r in rows.collect()) and {r.id: r.b for r in again} == {r.id: r.b for r in rows.collect()}
    found = E.permutation_importance(rows, "id", ["a", "b"], lambda t: M.pooled_scores(M.predict(model, t, ["a", "b"]))["macro_f1"], repeats=2)
    assert found["a"][0] > 0.2 > 0.05 > abs(found["b"][0])


def test_promotion(spark, rows, tmp_path):
    model = M.fit(rows, "Random Forest", ["a"], {"numTrees": 3})
    config, scores = M.frozen({"name": "Random Forest", "features": ["a"]}), {"macro_f1": 0.9}
    with pytest.raises(ValueError, match="frozen"):
        M.promote(spark, model, {**config, "features": ["b"]}, scores, scores, str(tmp_path))
    with pytest.raises(ValueError, match="differ"):
        M.promote(spark, model, config, scores, {"macro_f1": 0.8}, str(tmp_path))
    M.promote(spark, model, config, scores, scores, str(tmp_path))
    loaded, known = M.load(spark, str(tmp_path))
    pick = lambda m: [r.predicted for r in M.predict(m, rows, ["a"]).orderBy("id").collect()]
    assert known == config and pick(loaded) == pick(model)


def test_kernels_separate_rings_and_products(spark):
    rng = np.random.default_rng(8)
    turn, ring = rng.uniform(0, 2 * np.pi, 400), rng.integers(0, 2, 400)
    points = [(float((1 + 2 * r) * np.cos(t) + rng.normal(0, 0.1)), float((1 + 2 * r) * np.sin(t) + rng.normal(0, 0.1)), int(r)) for t, r in zip(turn, ring)]
    rings = spark.createDataFrame(points, "x double, y double, label int")
    share = lambda df, params: np.mean([r.predicted == r.label for r in M.predict(M.fit(df, "SVM", ["x", "y"], params), df, ["x", "y"]).collect()])
    assert share(rings, {"maxIter": 30}) < 0.75
    assert share(rings, {"maxIter": 30, "kernel": "rbf", "gamma": 0.7}) > 0.98
    assert share(rings, {"maxIter": 30, "kernel": "poly", "degree": 2, "gamma": 1.0}) > 0.98
    with pytest.raises(ValueError, match="kernel"):
        M.estimator("SVM", ["x"], {"kernel": "magic"})


def test_softmax_boosting_stops_early_by_the_stopping_blocks(spark, tmp_path):
    rng = np.random.default_rng(9)
    data = []
    for i in range(900):
        x, y = rng.uniform(-1, 1, 2)
        label = int(x > 0) + int(x > 0 and y > 0) if rng.random() > 0.15 else int(rng.integers(0, 3))
        data.append((1, i, float(x), None if i % 31 == 0 else float(y), label))
    rows = M.with_stopping_split(spark.createDataFrame(data, "worker long, event_id long, x double, y double, label int"), ["event_id"], block=30, purge=3).where("part <> 'purged'")
    rows = rows.withColumn("stop", rows.part == "stop")
    model = M.fit(rows, "Softmax Boosting", ["x", "y"], {"rounds": 12, "depth": 3, "rate": 1.5, "patience": 1, "stop": "stop"})
    assert 1 <= model.stages[-1].n_rounds < 11
    got = M.predict(model, rows, ["x", "y"]).collect()
    assert np.mean([r.predicted == r.label for r in got]) > 0.8 and all(abs(sum(r.probabilities) - 1) < 1e-9 for r in got)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert [tuple(r.probabilities) for r in M.predict(again, rows, ["x", "y"]).orderBy("event_id").collect()] == [tuple(r.probabilities) for r in sorted(got, key=lambda r: r.event_id)]


def test_preparation_is_exact(spark):
    rows = spark.createDataFrame([(1.0, 4.0), (3.0, None), (None, 4.0), (8.0, float("nan"))], "a double, b double")
    fitted = M.P.Preparation().given(columns=["a", "b"], out="f", scaled=True).fit(rows)
    a = np.array([1, 3, 3, 8.0])
    assert np.allclose([r.f.toArray() for r in fitted.transform(rows).collect()], np.stack([(a - a.mean()) / a.std(), np.zeros(4)], axis=1))


def test_importances_sum_to_one(rows):
    for name in ("Random Forest", "Logistic Regression", "SVM", "Boosted Trees"):
        found = M.importances(M.fit(rows, name, ["a", "b"], {"numTrees": 3} if name == "Random Forest" else {"maxIter": 3}), ["a", "b"])
        assert sum(found.values()) == pytest.approx(1) and found["a"] > found["b"]
    with pytest.raises(ValueError, match="importances"):
        M.importances(M.fit(rows, "SVM", ["a"], {"kernel": "rbf", "maxIter": 2}), ["a"])


def test_permutations_reach_all_rows_and_keep_their_seed(spark):
    for n in (1, 2, 5, 64, 1000, 1025):
        assert sorted(E.feistel(np.arange(n), n, 3).tolist()) == list(range(n))
    df = spark.createDataFrame([(i, i // 100) for i in range(2000)], "id long, v int")
    one = {r.id: r.v for r in E.shuffled(df.repartition(7), "id", "v", 5).collect()}
    assert one == {r.id: r.v for r in E.shuffled(df.coalesce(2), "id", "v", 5).collect()} != {r.id: r.v for r in E.shuffled(df, "id", "v", 6).collect()}
    assert sorted(one.values()) == sorted(i // 100 for i in range(2000))
    assert len({(i // 100, v) for i, v in one.items()}) > 350  # of 400 pairs of blocks


def test_a_stopped_search_ends_with_the_same_table(spark, rows, tmp_path, monkeypatch):
    from wearstream.models import search as S

    folds, sets = M.worker_folds(rows)[:2], {"SMALL": ["a"], "LARGE": ["a", "b"]}
    run = lambda path: S.staged(S.Ledger(spark, path), rows, folds, "Logistic Regression", [{"maxIter": 50}, {"maxIter": 1}], [{2: 2.0}], lambda p: [{**p, "regParam": 0.1}], feature_sets=sets)
    whole = run(str(tmp_path / "whole"))
    calls, real = [], M.fit
    with monkeypatch.context() as m:
        m.setattr(M, "fit", lambda *a, **k: (calls.append(1), real(*a, **k))[1] if len(calls) < 3 else (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            run(str(tmp_path / "part"))
    assert S.Ledger(spark, str(tmp_path / "part")).table().count() == 3
    resumed = []
    monkeypatch.setattr(M, "fit", lambda *a, **k: (resumed.append(1), real(*a, **k))[1])
    assert run(str(tmp_path / "part")) == whole
    tables = [{r.key: (r.config, r.fold, r.matrix) for r in S.Ledger(spark, str(tmp_path / x)).table().collect()} for x in ("whole", "part")]
    assert tables[0] == tables[1] and len(resumed) == len(tables[0]) - 3
    assert whole["set"] == "SMALL" and whole["params"]["maxIter"] == 50 and M.frozen(whole) == whole  # the other didn't converge
