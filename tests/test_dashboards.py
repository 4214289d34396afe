"""Whole views by hand cases: levels at their limits, factors in order, guidance of workers without helmet or data."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wearstream.functions import channels as N
from wearstream.operators import dashboards as D

NOW = datetime(2024, 1, 31)


def levels(spark, channel, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r.l for r in df.select("i", N.channel_level(channel, F.col("v")).alias("l")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "channel,values",
    [("ambientTemperature", (26.9, 27.0, 35.0, 35.1)), ("gas", (149.9, 150.0, 300.0, 300.1)), ("uv", (2.9, 3.0, 8.0, 8.1)), ("noise", (79.9, 80.0, 84.9, 85.0))],
)
def test_levels_at_their_limits(spark, channel, values):
    assert levels(spark, channel, [*values, None, float("nan"), float("inf")]) == ["SAFE", "WARNING", "WARNING", "CRITICAL", None, None, None]


def documents(spark, packets, states=(), emergencies=(), viewer="WORKER", helmet=True):
    """The guidance of worker 1, whose baselines are 80 and 36."""
    t = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    found = D.guidance_documents(
        t([(1, "one")], "worker_id long, name string"), t([(7, 1 if helmet else None)], "helmet long, wearer long"),
        t(packets, "worker long, ts timestamp_ntz, event_id long, ambientTemperature double, noise double, gas double, uv double, heartRate double, bodyTemperature double"),
        t([(1, 80.0, 36.0)], "worker_id long, heart double, body double"), t(states, "worker long, state string, uncertain boolean, reason string"), t([(w,) for w in emergencies], "worker long"),
        F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), seconds=180, attention_percent=20.0, viewer=viewer,
    )
    return found.collect()[0]


def packet(minute=0, **values):
    row = {"ambientTemperature": 20.0, "noise": 50.0, "gas": 10.0, "uv": 1.0, "heartRate": 80.0, "bodyTemperature": 36.0} | values
    return (1, datetime(2024, 1, 30, 23, 59 - minute), minute, *row.values())


def test_the_worst_factors_come_first_and_four_are_shown(spark):
    got = documents(spark, [packet(ambientTemperature=30.0, noise=90.0, gas=200.0, uv=9.0, heartRate=96.0)], [(1, "SAFE", False, None)])
    assert [(f.factor, f.severity) for f in got.factors] == [("noise", "CRITICAL"), ("uv", "CRITICAL"), ("ambientTemperature", "WARNING"), ("gas", "WARNING")]
    assert got.state == "CRITICAL" and got.attention == 5 and got.text == "5 conditions need attention at once."
    assert got.actions == ["reduceNoiseExposure", "avoidDirectSun", "hydrateAndRest", "monitorGasLevel", "checkWorkerCondition"]


def test_body_signals_are_told_but_only_the_heart_rate_calls(spark):
    got = documents(spark, [packet(heartRate=60.0, bodyTemperature=39.6)], [(1, "SAFE", False, None)])
    assert [(f.factor, f.detail, f.attention) for f in got.factors] == [("heartRate", "25.0 % under the baseline", True), ("bodyTemperature", "10.0 % over the baseline", False)]
    assert (got.state, got.attention, got.actions) == ("SAFE", 1, ["checkWorkerCondition"])


def test_a_silent_helmet_is_a_warning(spark):
    got = documents(spark, [packet(minute=30)], [(1, "SAFE", False, None)])
    assert got.factors[0].factor == "helmetCommunication" and got.readings == "last known" and not got.online
    assert got.state == "WARNING" and got.actions == ["restoreCommunication"] and got.text == "1 condition needs attention."


def test_doubt_hides_a_safe_risk_but_no_raised_one(spark):
    got = documents(spark, [packet()], [(1, "SAFE", True, "SENSOR_WARMUP")])
    assert got.state == "UNCERTAIN" and got.risk is None and got.actions == ["checkSensors"] and "heating up" in got.text
    got = documents(spark, [packet()], [(1, "WARNING", True, "SENSOR_WARMUP")])
    assert got.state == "WARNING" and got.risk == "WARNING" and got.actions == ["checkWorkerCondition"]


def test_without_helmet_or_data_there_are_no_factors(spark):
    for options, state in (({"helmet": False}, "NO_HELMET"), ({"packets": []}, "NO_DATA"), ({"packets": [], "emergencies": [1]}, "EMERGENCY")):
        got = documents(spark, **({"packets": [packet(noise=99.0)]} | options))
        assert (got.state, got.factors, got.actions, got.attention, got.online) == (state, [], [], 0, None)


@pytest.mark.parametrize("viewer,whom,first", [("ADMIN", "this worker", "locateCheckWorker"), ("WORKER", "you", "followEmergencyProcedure")])
def test_emergencies_speak_to_the_viewer(spark, viewer, whom, first):
    got = documents(spark, [packet(noise=99.0)], emergencies=[1], viewer=viewer)
    assert got.state == "EMERGENCY" and got.emergency and got.text == f"An emergency is on for {whom}." and got.actions[0] == first


def test_newest_keeps_the_last_of_each_key_and_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, i, NOW) for i in range(8)] + [(2, 9, NOW)], "worker long, event_id long, ts timestamp_ntz")
    got = D.newest(rows, ["worker"], 3)
    assert sorted((r.worker, r.place, r.event_id) for r in got.collect()) == [(1, 1, 7), (1, 2, 6), (1, 3, 5), (2, 1, 9)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()  # cut before the exchange too


def test_assembled_puts_each_type_where_it_belongs(spark):
    rows = spark.createDataFrame([(None, 3, True, NOW, "x", None)], "k string, a int, b boolean, t timestamp_ntz, s string, n double")
    got = {r.name: (r.item, r.number, r.text) for r in D.assembled({"p": (rows, ["k"])}).collect()}
    assert got == {"a": ("", 3.0, None), "b": ("", 1.0, None), "t": ("", 1706659200000000.0, None), "s": ("", None, "x"), "n": ("", None, None)}
