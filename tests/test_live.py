"""Live features against plain windows, scoring of READY rows, votes and alerts; streams against tables."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_quality_gate import CLEAN, SCHEMA, reading, run, table_rows
from wearstream.models import training
from wearstream.streaming import live, runs
from wearstream.streaming import quality as Q


def test_features_are_those_of_the_contract_in_its_order():
    assert Q.FEATURES == training.FEATURE_SETS["EXTENDED"] == live.trained_features()
    assert len(Q.FEATURES) == 38 and len(Q.DEFERRABLE) == 9


def wavy(n, seed=1):
    """Readings once a second whose channels vary without jumps, with some missing and some lost ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rng.random() < 0.03:
            continue
        r = reading(i, heart_rate=80 + 15 * math.sin(i / 20) + rng.normal(), body_temperature=36.6 + 0.3 * math.sin(i / 50), ambient_temperature=30 + 6 * math.sin(i / 70), uv_index=4 + 4 * math.sin(i / 60), gas=9.0 + 12 * (math.sin(i / 30) > 0.7), noise=82 + 6 * math.sin(i / 15))
        for c in ("uv_index", "gas", "noise"):
            if rng.random() < 0.05:
                r[c] = None
        rows.append(r)
    return rows


def plain_features(rows, k):
    """The features of rows[k] straight from their definitions, for readings without artifacts in one session."""
    t, r = rows[k]["us"] / 1e6, rows[k]
    seen = lambda c, a, b=0.0: [x[c] for x in rows[: k + 1] if x[c] is not None and t - a < x["us"] / 1e6 <= t - b]
    held = {c: next((x[c] for x in reversed(rows[: k + 1]) if x[c] is not None and t - x["us"] / 1e6 <= Q.CHANNELS[c].hold), None) for c in Q.CHANNELS}
    began = rows[0]["us"] / 1e6
    first = [x["gas"] for x in rows[: k + 1] if x["gas"] is not None and x["us"] / 1e6 - began < 180]
    gas = statistics.median(first) if len(first) >= 20 else None
    f = dict(held)
    f["hr_deviation_bpm"], f["body_temp_deviation_c"] = held["heart_rate"] - 80, held["body_temperature"] - 36.6
    f["hr_deviation_pct"], f["body_temp_deviation_pct"] = f["hr_deviation_bpm"] / 80 * 100, f["body_temp_deviation_c"] / 36.6 * 100
    f["gas_ratio_to_baseline"] = held["gas"] / gas if gas and held["gas"] is not None else None
    for name, (c, seconds, stat, least) in Q.ROLLING.items():
        v = seen(c, seconds)
        f[name] = None if len(v) < least else statistics.fmean(v) if stat == "mean" else statistics.stdev(v)
    for name, (c, window, part) in Q.TRENDS.items():
        late, early = seen(c, part), seen(c, window, window - part)
        f[name] = None if min(len(late), len(early)) < part // 2 else (statistics.median(late) - statistics.median(early)) / (window - part) * 60
    dose = 0.0
    for a, b in zip([None, *rows], rows[: k + 1]):
        if b["noise"] is not None and b["noise"] >= 80:
            dose += 100 * (1.0 if a is None else min(1.0, (b["us"] - a["us"]) / 1e6)) / 60 / (480 / 2 ** ((b["noise"] - 85) / 3))
    f["noise_dose_pct"] = dose
    return f, gas


def test_features_equal_their_definitions():
    rows = wavy(700)
    gate = Q.Gate(Q.Rules())
    counters = dict.fromkeys(Q.COUNTERS)
    for k, r in enumerate(rows):
        gate.reading(r)
        want, gas = plain_features(rows, k)
        t = r["us"] / 1e6
        for name, (c, seconds, form, *levels) in Q.EXPOSURES.items():
            v = [x[c] for x in rows[: k + 1] if x[c] is not None and t - seconds < x["us"] / 1e6]
            m = statistics.fmean(v) if v else None
            level = None if m is None else {"mean": lambda: m, "leq": lambda: 10 * math.log10(statistics.fmean(10 ** (x / 10) for x in v)), "ratio": lambda: m / gas if gas else None, "percent": lambda: (m - 80) / 80 * 100, "units": lambda: m - 36.6}[form]()
            for kind, limit in zip(("warning", "critical"), levels):
                key = f"{name}_{kind}_exposure_sec"
                on = level is not None and level >= limit
                counters[key] = (counters[key] + (r["us"] - rows[k - 1]["us"]) / 1e6 if counters[key] else 1.0) if on else None
                want[key] = counters[key] or 0.0
        for c in Q.FEATURES:
            assert (gate.features[c] is None) == (want[c] is None), (k, c)
            assert want[c] is None or gate.features[c] == pytest.approx(want[c], abs=1e-9), (k, c)
    assert any(gate.features[c] for c in Q.COUNTERS)


def test_a_warm_restart_defers_nine_features():
    gate = Q.Gate(Q.Rules())
    run(gate, 300)
    out = []
    for i in range(260):
        out.append((gate.reading(reading(7500 + i))[1], dict(gate.features)))
    assert [s for s, _ in out[:20]] == ["UNCERTAIN"] * 19 + ["READY"]
    assert {c for c in Q.FEATURES if out[19][1][c] is None} == Q.DEFERRABLE
    assert out[58][1]["uv_rolling_mean_300s"] is None and out[59][1]["uv_rolling_mean_300s"] == 2.0
    assert out[248][1]["uv_trend_300s_per_min"] is None and out[249][1]["uv_trend_300s_per_min"] == 0.0


def test_counters_restart_with_a_session_and_the_dose_with_a_workday():
    gate = Q.Gate(Q.Rules())
    run(gate, 400, noise=95.0, ambient_temperature=40.0)
    assert gate.features["noise_critical_exposure_sec"] == gate.features["temp_critical_exposure_sec"] == 400
    dose = gate.features["noise_dose_pct"]
    assert dose == pytest.approx(400 * 100 / 60 / (480 / 2 ** (10 / 3)))
    run(gate, 25, start=7600)
    assert gate.features["noise_critical_exposure_sec"] == 0 and gate.features["noise_dose_pct"] == dose
    run(gate, 1, start=90000, workday=2)
    assert gate.features["noise_dose_pct"] == 0


def test_references_of_slow_channels_outlast_a_minute():
    gate = Q.Gate(Q.Rules())
    run(gate, 200)
    run(gate, 2, start=300)
    out = gate.reading(reading(302, body_temperature=39.5))
    assert out[2] == "UNCERTAIN" and gate.s["session"]["channels"]["body_temperature"]["odd"] and out[4] == ["body_temperature"]


def test_unreadable_packets_do_not_hold_alerts_back():
    gate, alerts = Q.Gate(Q.Rules()), []
    run(gate, 200)
    for i in range(200, 400):
        if i % 20 == 0:
            r = {**reading(i), "us": None}
            assert not gate.alert(None, gate.reading(r)[3])
        else:
            r = reading(i, gas=None)
            if gate.alert(r["us"], gate.reading(r)[3]):
                alerts.append(i)
    assert alerts == [235]


def decided(rows):
    """States of (session, status, reasons, predicted, confidence) once a second."""
    fold = live.Votes(live.Decisions())
    now, out = fold.begin({}), []
    for i, (session, status, reasons, predicted, confidence, *rest) in enumerate(rows):
        r = fold.step(now, {"seq": i, "us": i * 1_000_000, "session": session, "status": status, "reasons": reasons, "predicted": predicted, "confidence": confidence, "backstop": rest[0] if rest else None})
        out.append(dict(zip([c.split()[0] for c in live.STATES_OUT.split(", ")][1:], r)))
    return out


def ready(level, p=0.9, session=1, *rest):
    return (session, "READY", [], level, p, *rest)


UNSURE = (1, "UNCERTAIN", ["PACKET_LOSS"], None, None)


def test_votes_skip_uncertain_rows_and_sessions_clear_them():
    out = decided([ready("WARNING")] * 3 + [UNSURE] * 3 + [ready("SAFE")] * 2 + [ready("SAFE", session=2)])
    assert [o["confirmed"] for o in out] == ["WARNING"] * 8 + ["SAFE"]
    assert [o["state"] for o in out[3:8]] == ["UNCERTAIN"] * 3 + ["SAFE"] * 2 and out[7]["smoothed"] == "WARNING"
    assert [(o["changed_from"], o["changed_to"]) for o in out if o["changed_to"]] == [(None, "WARNING")]  # a session's first SAFE is no event
    tied = decided([ready("SAFE")] * 2 + [ready("CRITICAL")] * 2)
    assert tied[3]["confirmed"] == "CRITICAL" and tied[3]["changed_from"] == "SAFE"


def test_low_confidence_does_not_vote_and_backstops_raise():
    out = decided([ready("CRITICAL", 0.55), ready("SAFE"), ready("SAFE", 0.9, 1, "CRITICAL"), ready("CRITICAL", 0.9, 1, "WARNING"), (*UNSURE, "WARNING")])
    assert out[0]["state"] == "UNCERTAIN" and out[0]["reason"] == "LOW_CONFIDENCE" and out[0]["confirmed"] is None
    assert [o["state"] for o in out[1:]] == ["SAFE", "CRITICAL", "CRITICAL", "WARNING"] and out[4]["reason"] is None


def test_data_quality_alerts_once_in_an_episode():
    late = (1, "UNCERTAIN", ["BASELINE_UNAVAILABLE"], None, None)
    warm = (1, "UNCERTAIN", ["SENSOR_WARMUP", "INSUFFICIENT_HISTORY"], None, None)
    out = decided([late] * 80)
    assert [i for i, o in enumerate(out) if o["alert"]] == [30] and out[30]["alert_reason"] == "BASELINE_UNAVAILABLE" and out[30]["alert_since"] == 0
    assert not any(o["alert"] for o in decided([warm] * 120))
    assert not any(o["alert"] for o in decided(([late] * 29 + [ready("SAFE")]) * 4))


def streamed(spark, rows, path, files, schema=SCHEMA):
    n = -(-len(rows) // files)
    for i in range(0, len(rows), n):
        spark.createDataFrame(rows[i : i + n], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def model(spark):
    """Warm ambient air is a warning, and a high heart rate is critical."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(900):
        heart, air = float(rng.uniform(60, 180)), float(rng.uniform(20, 45))
        rows.append((heart, air, 2 if heart > 140 else 1 if air > 32 else 0))
    df = spark.createDataFrame(rows, "heart_rate double, ambient_temperature double, label int")
    return training.fit(df, "Random Forest", ["heart_rate", "ambient_temperature"], {"numTrees": 20, "maxDepth": 6, "featureSubsetStrategy": "all"})


def test_stream_and_table_agree_from_readings_to_states(spark, tmp_path, model):
    rows = []
    for i in range(300):
        for worker in (1, 2):
            r = reading(i, helmet="H1" if (worker == 1) == (i < 240) else "H2", heart_rate=80.0 + 70 * (i > 260) + i % 3, ambient_temperature=36.0 if 200 < i < 250 else 25.0)
            if i % 50 != 7:
                rows.append((worker, *[{**r, "seq": 2 * i + worker}[c] for c in Q.COLUMNS]))
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plain = {(r.worker, r.seq): r for r in live.live_states(table, model).collect()}
    stream = streamed(spark, rows, str(tmp_path / "in"), 4)
    assert {(r.worker, r.seq): r for r in runs.finished(live.live_states(stream, model)).collect()} == plain
    assert len(plain) == len(rows)
    mine = sorted((r for r in plain.values() if r.worker == 1), key=lambda r: r.seq)
    moved = [(r.changed_from, r.changed_to) for r in mine if r.changed_to]
    assert moved[0] == ("SAFE", "WARNING") and ("SAFE", "CRITICAL") in moved + [(None, "CRITICAL")]
    assert {r.session for r in mine} == {1, 2, 3}  # it takes another helmet, and another takes its own
    events = live.transitions(spark.createDataFrame(mine)).collect()
    assert [(e.changed_from, e.changed_to) for e in sorted(events, key=lambda e: e.seq) if e.kind == "RISK_STATE"] == moved


def test_only_ready_rows_are_scored(spark, model):
    rows = [(1, *[reading(i, gas=None if 230 <= i < 250 else 9.0)[c] for c in Q.COLUMNS]) for i in range(300)]
    out = live.scored(Q.live_features(spark.createDataFrame(rows, SCHEMA)), model)
    got = out.groupBy("status").agg(F.count("predicted").alias("p"), F.count("confidence").alias("c"), F.count("heart_rate").alias("h"), F.count("*").alias("n")).collect()
    by = {r.status: r for r in got}
    assert by["READY"].p == by["READY"].c == by["READY"].n == by["READY"].h > 80 and by["UNCERTAIN"].p == by["UNCERTAIN"].h == 0
    first = out.where("status = 'READY'").first()
    assert set(first.probabilities) == set(live.LEVELS) and first.confidence == pytest.approx(max(first.probabilities.values()))


def test_handovers_of_a_stream_are_those_of_a_table(spark, tmp_path):
    rows = table_rows(120)
    key = lambda df: sorted((r.worker, r.seq, r.control or "", r.helmet or "") for r in df.collect())
    table = spark.createDataFrame(rows, SCHEMA)
    want = key(Q.handed_over(table))
    assert key(live.handovers(table)) == want and sum(c == "handover" for _, _, c, _ in want) == 2
    assert key(runs.finished(live.handovers(streamed(spark, rows, str(tmp_path / "in"), 5)))) == want
    gate = lambda df: {(r.worker, r.seq): r for r in df.collect()}
    chained = Q.readings_gate(live.handovers(streamed(spark, rows, str(tmp_path / "again"), 3)))
    assert gate(runs.finished(chained)) == gate(Q.readings_gate(Q.handed_over(table)))
    alone = spark.createDataFrame([(3, *[{**CLEAN, "seq": 0, "us": 0}[c] for c in Q.COLUMNS]), (None, *[reading(1, helmet="H9")[c] for c in Q.COLUMNS])], SCHEMA)
    assert live.handovers(alone).count() == 2


def test_a_session_in_a_restarted_stream_goes_on(spark, tmp_path):
    rows = [(1, *[r[c] for c in Q.COLUMNS]) for r in wavy(120)]
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]
    for part in (rows[:40], rows[40:90], rows[90:]):
        stream = streamed(spark, part, paths[0], 1)
        Q.live_features(stream, audit=True).writeStream.format("parquet").option("path", paths[1]).option("checkpointLocation", paths[2]).trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: r for r in spark.read.parquet(paths[1]).collect()}
    assert got == {r.seq: r for r in Q.live_features(spark.createDataFrame(rows, SCHEMA), audit=True).collect()} and len(got) == len(rows)


def test_without_a_model_nothing_counts(spark):
    rows = [(1, *[reading(i)[c] for c in Q.COLUMNS]) for i in range(240)]
    out = live.live_states(spark.createDataFrame(rows, SCHEMA), None).orderBy("seq").collect()
    assert {r.reason for r in out[:180]} == {"SENSOR_WARMUP"} and {r.reason for r in out[181:]} == {"ML_SERVICE_UNAVAILABLE"}
    assert all(r.state == "UNCERTAIN" and r.confirmed is None for r in out) and [r.seq for r in out if r.alert] == [210]
