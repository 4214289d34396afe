import pandas as pd

from wearstream.streaming import runs, stateful

SECOND = 1_000_000


def stream_of(spark, tmp_path, batches, schema):
    """One file, and so one trigger, for each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_emergencies_keep_their_phase_between_triggers(spark, tmp_path):
    first = [(1, 2, 2, "request"), (1, 1, 1, "press"), (2, 1, 1, "ack"), (2, 2, 2, "request")]
    then = [(1, 3, 3, "request"), (1, 4, 4, "press"), (1, 5, 5, "ack"), (1, 6, 6, None), (2, 3, 3, "press"), (2, 4, 4, "press")]
    stream = stream_of(spark, tmp_path, [first, then], "worker long, seq long, us long, action string")
    got = {(r.worker, r.seq): (r.phase, r.outcome) for r in runs.finished(stateful.emergencies(stream)).collect()}
    assert got == {
        (1, 1): ("active", "activated"), (1, 2): ("reset_requested", "requested"), (1, 3): ("reset_requested", "repeated"),
        (1, 4): ("reset_requested", "refreshed"), (1, 5): ("inactive", "resolved"), (1, 6): ("inactive", "ignored"),
        (2, 1): ("inactive", "stale"), (2, 2): ("inactive", "refused"), (2, 3): ("active", "activated"), (2, 4): ("active", "refreshed"),
    }


def test_gate_sessions_late_rows_and_alerts(spark, tmp_path):
    limits = stateful.Limits(session_gap=100, cold_after=1000, cold_warmup=2, least_samples=2, refill_gap=5, alert_after=3, alert_pause=50)
    times = [0, 1, 2, 3, 2, 4, 14, 15, 16, 17, 18, 19, 20, 200, 201, 202, 203]
    values = [1.0] * 8 + [None] * 5 + [1.0] * 4
    rows = [(1, i, t * SECOND, 0 if t < 203 else 1, v) for i, (t, v) in enumerate(zip(times, values))]
    stream = stream_of(spark, tmp_path, [rows[:6], rows[6:10], rows[10:]], "worker long, seq long, us long, workday long, value double")
    found = runs.finished(stateful.gate(stream, limits)).toPandas().sort_values("seq")
    reasons = ["SENSOR_WARMUP"] * 2 + [None, None, "OUT_OF_ORDER_TIMESTAMP", None, "MAJOR_TIMESTAMP_GAP", None] + ["SENSOR_UNAVAILABLE"] * 5
    reasons += ["INSUFFICIENT_HISTORY", None, None, "SENSOR_WARMUP"]
    assert [None if pd.isna(r) else r for r in found.reason] == reasons
    assert [None if pd.isna(x) else int(x) for x in found.session] == [1, 1, 1, 1, None, 1] + [1] * 7 + [2, 2, 2, 3]
    assert list(found.status == "READY") == [r is None for r in reasons]
    assert found.seq[found.alert].tolist() == [11]


def test_empty_stream(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[]], "worker long, seq long, us long, action string")
    assert runs.finished(stateful.emergencies(stream)).count() == 0
