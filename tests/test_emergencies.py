"""Emergency packets, their course over several streams, live updates, and keyed upserts."""

import json

import pytest
from pyspark.sql import functions as F

from wearstream.streaming import emergencies as E
from wearstream.streaming import keyed, live, runs, sinks, updates
from tests.test_live import ready, UNSURE

GOOD = {"helmetId": "H1", "timestamp": "2026-10-09T03:30:00Z", "emergency": True}


@pytest.mark.parametrize("change, problems", [
    ({}, []), ({"helmetId": None}, ["NO_HELMET"]), ({"helmetId": 7}, ["NO_HELMET"]), ({"helmetId": ""}, ["NO_HELMET"]), ({"timestamp": None}, ["NO_TIME"]), ({"timestamp": ""}, ["NO_TIME"]),
    ({"timestamp": "soon"}, ["BAD_TIME"]), ({"timestamp": 1791516600000}, []), ({"timestamp": 0}, ["NO_TIME"]), ({"emergency": False}, ["NO_EMERGENCY"]), ({"emergency": "true"}, ["NO_EMERGENCY"]),
    ({"emergency": None, "status": {"overall": "EMERGENCY"}}, []), ({"gps": None}, []), ({"gps": {"lat": 6.9, "lon": 79.8}}, []), ({"gps": 5}, ["BAD_GPS"]), ({"gps": [1, 2]}, ["BAD_GPS"]),
    ({"gps": {"lat": 91, "lon": 79.8}}, ["BAD_LAT"]), ({"gps": {"lat": "6", "lon": None}}, ["BAD_LAT", "BAD_LON"]), ({"helmetId": None, "timestamp": None, "emergency": None}, ["NO_HELMET", "NO_TIME", "NO_EMERGENCY"]),
])
def test_packets_are_checked(spark, change, problems):
    row = E.packets(spark.createDataFrame([(json.dumps(GOOD | change),)], "value string")).first()
    assert row.problems == problems
    if not problems:
        assert row.helmet == "H1" and row.us == 1791516600000000
        assert (row.lat, row.lon) == ((6.9, 79.8) if change.get("gps") else (None, None))
    else:
        assert row.helmet is None and row.us is None


def test_packets_that_are_no_objects(spark):
    df = spark.createDataFrame([("[1]",), ("nonsense",), (None,), ("5",)], "value string")
    assert [r.problems for r in E.packets(df).collect()] == [["NOT_AN_OBJECT"]] * 4


ACTIONS = [
    (1, "H1", "poll", None), (2, "H1", "ack", None), (3, "H1", "request", None), (4, "H1", "press", (6.9, 79.8)), (5, "H1", "press", None), (6, "H1", "press", (7.0, 80.0)), (7, "H1", "poll", None),
    (8, "H1", "ack", None), (9, "H1", "request", None), (10, "H1", "request", None), (11, "H1", "poll", None), (12, "H1", "press", (7.1, 80.1)), (13, "H1", "ack", None), (14, "H1", "ack", None),
    (15, "H1", "press", None), (16, "H2", "press", None), (17, "H9", "press", None), (18, "H9", "poll", None),
]
WANT = ["answered", "stale", "NO_ACTIVE_EMERGENCY", "activated", "refreshed", "refreshed", "answered", "stale", "requested", "repeated", "answered", "refreshed", "resolved", "stale", "activated"]


def streams(read):
    return E.united(**{a: read(a).select("seq", (F.col("seq") * 1_000_000).alias("us"), "helmet", "lat", "lon") for a in E.ACTIONS})


def test_several_streams_are_one_course(spark, tmp_path):
    schema = "seq long, helmet string, action string, lat double, lon double"
    rows = spark.createDataFrame([(s, h, a, *(g or (None, None))) for s, h, a, g in ACTIONS], schema)
    wearers = spark.createDataFrame([("H1", 1), ("H2", 2)], "helmet string, worker long")
    known, lost = E.resolved_workers(streams(lambda a: rows.where(F.col("action") == a)), wearers)
    course = E.emergencies(known)
    mine = sorted((r for r in course.collect() if r.worker == 1), key=lambda r: r.seq)
    assert [r.outcome for r in mine] == WANT
    assert [r.reset for r in mine if r.action == "poll"] == [False, False, True]
    assert [(r.lat, r.lon) for r in mine[3:6]] == [(6.9, 79.8), (6.9, 79.8), (7.0, 80.0)]
    assert sorted((r.worker, r.episode, r.started_us, r.resolved_us, r.presses, r.lat) for r in E.alerts(course).collect()) == [(1, 1, 4_000_000, 13_000_000, 4, 7.1), (1, 2, 15_000_000, None, 1, None), (2, 1, 16_000_000, None, 1, None)]
    assert sorted((r.seq, r.outcome, r.reset) for r in lost.collect()) == [(17, "WORKER_NOT_FOUND", None), (18, "answered", False)]
    assert sorted((r.seq, r.audience) for r in E.notices(course).where("worker = 1").collect()) == [(4, "admin"), (9, "admin"), (9, "worker"), (13, "admin"), (13, "worker"), (15, "admin")]
    for a in E.ACTIONS:
        rows.where(F.col("action") == a).coalesce(1).write.parquet(str(tmp_path / a))
    live_known, _ = E.resolved_workers(streams(lambda a: spark.readStream.schema(schema).parquet(str(tmp_path / a))), wearers)
    assert sorted(map(tuple, runs.finished(E.emergencies(live_known)).collect()), key=str) == sorted(map(tuple, course.collect()), key=str)
    with pytest.raises(ValueError):
        E.united(shout=rows)


def test_updates_reach_the_worker_and_the_admins_once(spark, tmp_path):
    rows = [(w, i, i * 1_000_000, *r[:5]) for w in (1, 2) for i, r in enumerate([ready("WARNING")] * 3 + [UNSURE])]
    schema = "worker long, seq long, us long, session long, status string, reasons array<string>, predicted string, confidence double"
    followers = spark.createDataFrame([("w1", "worker", 1), ("w2", "worker", 2), ("boss", "admin", None)], "recipient string, role string, worker long")
    decided = live.states(spark.createDataFrame(rows, schema))
    decided.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(decided.schema).parquet(str(tmp_path / "in"))
    got = lambda who, name="points": sorted((r.worker, r.seq, r.state, r.confidence, r.reason) for r in updates.received(spark, str(tmp_path / "out"), who, name).collect())
    for _ in range(2):  # the second run has lost its checkpoint, so its batch comes again
        updates.published(stream, followers, str(tmp_path / "out"), str(tmp_path / f"c{_}")).awaitTermination()
        assert got("w1") == [(1, 0, "WARNING", 0.9, None), (1, 1, "WARNING", 0.9, None), (1, 2, "WARNING", 0.9, None), (1, 3, "UNCERTAIN", None, "PACKET_LOSS")]
        assert len(got("boss")) == 8 and [x[0] for x in got("w2")] == [2] * 4
        assert got("w2", "snapshots") == [(2, 3, "UNCERTAIN", None, "PACKET_LOSS")]


def files(path):
    return {str(p.relative_to(path)): p.stat().st_size for p in path.rglob("*.parquet")}


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    table = sinks.Upserts(spark, str(tmp_path / "t"), buckets=32)
    rows = spark.range(4000).select("id", F.lit(1).cast("long").alias("n"), F.lit("old").alias("x"))
    assert table.table() is None
    table.merge(rows, 0, "id", ["n"])
    before = files(tmp_path / "t")
    assert len({p.split("/")[1] for p in before}) == 32
    two = spark.createDataFrame([(5, 2, "new"), (6, 0, "late"), (9999, 1, "more")], "id long, n long, x string")
    table.merge(two, 1, "id", ["n"])
    after = files(tmp_path / "t")
    fresh = {p: n for p, n in after.items() if p not in before}
    assert 1 <= len(fresh) <= 3 and sum(fresh.values()) < sum(before.values()) / 5
    got = {r.id: (r.n, r.x) for r in table.table().collect()}
    assert len(got) == 4001 and got[5] == (2, "new") and got[6] == (1, "old") and got[9999] == (1, "more")
    assert table.merge(two.withColumn("x", F.lit("again")), 1, "id", ["n"])["batch"] == 1 and files(tmp_path / "t") == after  # a retry
    for k in range(2, 8):
        table.merge(two.withColumn("n", F.lit(k + 1).cast("long")), k, "id", ["n"])
    names = sinks.Folder(spark, str(tmp_path / "t")).names()
    assert sum(n.startswith("manifest") for n in names) == sinks.KEPT_MANIFESTS and sum(n.startswith("data") for n in names) <= 1 + sinks.KEPT_MANIFESTS
    assert len(table.table().collect()) == 4001
    with pytest.raises(ValueError):
        sinks.Upserts(spark, str(tmp_path / "t"), buckets=8).merge(two, 99, "id", ["n"])


def test_a_run_that_dies_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    table = sinks.Upserts(spark, str(tmp_path / "t"), buckets=4)
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, n long, x string")
    two = spark.createDataFrame([(1, 2, "c")], "id long, n long, x string")
    table.merge(one, 0, "id", ["n"])
    with monkeypatch.context() as m:
        m.setattr(sinks.Folder, "put", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            table.merge(two, 1, "id", ["n"])
    assert sorted((r.id, r.x) for r in table.table().collect()) == [(1, "a"), (2, "b")]
    table.merge(two, 1, "id", ["n"])
    assert sorted((r.id, r.x) for r in table.table().collect()) == [(1, "c"), (2, "b")]
    homes = [n for n in table.folder.names() if n.startswith("data")]
    assert len(homes) == 2  # what the dead run wrote is gone
    assert keyed.ROCKS.endswith("Provider")
