"""The quality gate by hand cases: clean readings come once a second, and one thing goes wrong at a time."""

import json

import pytest

from wearstream.streaming import quality as Q
from wearstream.streaming import runs

CLEAN = {"workday": 1, "helmet": None, "baseline_hr": 80.0, "baseline_bt": 36.6, "gas_override": None, "heart_rate": 80.0, "body_temperature": 36.6, "ambient_temperature": 25.0, "uv_index": 2.0, "gas": 9.0, "noise": 60.0, "hr_contact": None, "bt_contact": None, "control": None}


def reading(second, **other):
    return {"seq": second, "us": int(second * 1e6), **CLEAN, **other}


def run(gate, n, start=0, **other):
    """(session, status, quality, reasons, imputed, heart rate, gas baseline) of n readings from a second on."""
    return [gate.reading(reading(start + i, **other)) for i in range(n)]


@pytest.fixture
def warm():
    gate = Q.Gate(Q.Rules())
    run(gate, 200)
    return gate


def test_cold_start_warms_up_for_180_seconds():
    out = run(Q.Gate(Q.Rules()), 182)
    assert all(o[1] == "UNCERTAIN" and o[3][0] == "SENSOR_WARMUP" for o in out[:180])
    assert out[180][1:4] == ("READY", "VALID", [])


def test_warm_restart_needs_20_samples():
    gate = Q.Gate(Q.Rules())
    run(gate, 300)
    out = run(gate, 40, start=7500)
    assert all(o[3][0] == "INSUFFICIENT_HISTORY" for o in out[:19]) and out[19][1] == "READY" and out[19][0] == 2
    assert run(gate, 1, start=7540, workday=2)[0][3][0] == "SENSOR_WARMUP"


def test_baseline_may_come_in_a_session_and_a_changed_one_ends_it():
    gate = Q.Gate(Q.Rules())
    assert run(gate, 200, baseline_hr=None)[-1][3][0] == "BASELINE_UNAVAILABLE"
    assert run(gate, 1, start=200)[0][:2] == (1, "READY")
    assert run(gate, 1, start=201, baseline_bt=36.9)[0][0] == 2
    assert run(gate, 1, start=202, baseline_bt=None)[0][0] == 3


def test_short_dropouts_are_held_and_long_ones_not(warm):
    out = run(warm, 8, start=200, uv_index=None)
    assert out[0][1:5] == ("READY", "IMPUTED", [], ["uv_index"]) and out[-1][3] == ["SENSOR_UNAVAILABLE", "REQUIRED_FEATURES_UNAVAILABLE"]


def test_lost_contact_and_ranges(warm):
    assert run(warm, 6, start=200, heart_rate=None)[-1][3][0] == "BODY_CONTACT_FAILURE"
    assert run(warm, 6, start=206, hr_contact=False)[-1][3][0] == "BODY_CONTACT_FAILURE"
    assert run(warm, 6, start=212, heart_rate=250.0)[-1][3][0] == "SENSOR_UNAVAILABLE"
    assert run(warm, 12, start=218, body_temperature=20.0)[-1][3][0] == "BODY_CONTACT_FAILURE"


def test_two_channels_down(warm):
    assert "TOO_MANY_MISSING_SENSORS" in run(warm, 12, start=200, gas=None, noise=None)[-1][3]


def test_out_of_order_readings_change_nothing(warm):
    before = json.dumps(warm.s)
    assert warm.reading(reading(150))[:4] == (None, "UNCERTAIN", "UNCERTAIN", ["OUT_OF_ORDER_TIMESTAMP"]) and json.dumps(warm.s) == before
    assert warm.reading(reading(199))[3] == ["OUT_OF_ORDER_TIMESTAMP"] and warm.reading({**reading(0), "us": None})[3] == ["INVALID_PACKET"]


def test_a_spike_is_held_and_a_step_is_accepted(warm):
    spike = warm.reading(reading(200, heart_rate=150.0))
    assert spike[2] == "IMPUTED" and spike[5] == 80.0 and all(v == 80.0 for _, v in warm.s["session"]["channels"]["heart_rate"]["kept"])
    warm.reading(reading(201))
    out = run(warm, 4, start=202, heart_rate=130.0)
    assert [o[5] for o in out] == [80.0, 80.0, 130.0, 130.0] and [o[2] for o in out] == ["IMPUTED", "IMPUTED", "VALID", "VALID"]
    assert [v for _, v in warm.s["session"]["channels"]["heart_rate"]["kept"]][-4:] == [130.0] * 4


def test_suspects_that_do_not_agree_make_the_heart_rate_unstable(warm):
    out = [warm.reading(reading(200 + i, heart_rate=130.0 + 60 * (i % 2))) for i in range(6)]
    assert "UNSTABLE_HR" not in out[2][3] and "UNSTABLE_HR" in out[4][3]


def test_gap_refill_then_loss(warm):
    out = run(warm, 31, start=260)
    assert all("MAJOR_TIMESTAMP_GAP" in o[3] for o in out[:19]) and out[19][3] == ["PACKET_LOSS"] and out[29][1] == "READY"


def test_one_reading_a_minute_is_never_ready():
    gate = Q.Gate(Q.Rules())
    assert all(gate.reading(reading(60 * i))[1] == "UNCERTAIN" for i in range(30))


def test_gas_baseline_is_provisional_then_frozen():
    gate = Q.Gate(Q.Rules())
    out = [gate.reading(reading(i, gas=9.0 + (i > 100))) for i in range(260)]
    assert out[18][6] is None and "GAS_BASELINE_UNAVAILABLE" in out[18][3] and out[19][6] == 9.0 == out[259][6]
    assert run(Q.Gate(Q.Rules()), 1, gas_override=4.0)[0][6] == 4.0


def test_state_survives_its_text_form():
    a = Q.Gate(Q.Rules())
    run(a, 200)
    b = Q.Gate(Q.Rules(), json.loads(json.dumps(a.s)))
    for i in range(200, 260):
        r = reading(i, heart_rate=80.0 + i % 9, noise=70.1 + i % 23)
        assert a.reading(r) == b.reading(r)


def test_alerts_look_at_all_reasons(warm):
    alerts = lambda gate, start, n, **other: [start + i for i in range(n) if gate.alert(int((start + i) * 1e6), gate.reading(reading(start + i, **other))[3])]
    assert alerts(warm, 200, 100, gas=None) == [235]  # held for five seconds, then 30 more
    assert alerts(warm, 300, 5) == [] and alerts(warm, 305, 200, gas=None) == []  # too soon after the last
    fresh = Q.Gate(Q.Rules())
    assert alerts(fresh, 0, 100, gas=None) == [30]  # a dead sensor counts while the session warms up
    assert alerts(Q.Gate(Q.Rules()), 0, 150) == []


SCHEMA = "worker long, seq long, us long, workday long, helmet string, baseline_hr double, baseline_bt double, gas_override double, heart_rate double, body_temperature double, ambient_temperature double, uv_index double, gas double, noise double, hr_contact boolean, bt_contact boolean, control string"


def table_rows(n):
    """Two workers; the second takes the first one's helmet over at reading 60."""
    rows = []
    for i in range(n):
        r = reading(i, helmet="H1", heart_rate=80.0 + i % 5, gas=None if i % 40 > 30 else 9.0)
        worker = 1 if i < 60 or i >= 80 else 2
        rows.append((worker, *[r[c] for c in Q.COLUMNS]))
    return rows


def test_a_table_and_a_stream_agree_and_helmets_change_hands(spark, tmp_path):
    rows = table_rows(120)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {(r.worker, r.seq): r for r in Q.readings_gate(df.repartition(5)).collect()}
    assert len(plain) == 120
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = {(r.worker, r.seq): r for r in runs.finished(Q.readings_gate(stream)).collect()}
    assert streamed == plain
    handed = {(r.worker, r.seq): r for r in Q.readings_gate(Q.handed_over(df)).collect()}
    assert set(handed) == set(plain)
    assert plain[1, 80].session == 1 and handed[1, 80].session == 2 and handed[1, 59].session == 1  # gone to another, and back
    assert Q.readings_gate(df.where("false")).count() == 0
