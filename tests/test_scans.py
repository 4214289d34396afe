"""Scans by slices of time against loops over a worker's rows, with one worker in many slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearstream.models import training as M
from wearstream.operators import scans as C
from wearstream.operators import timelines as T
from wearstream.operators import windows as W

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def rows(spark):
    """One worker with 64 hours and gaps, one with a single row, one with none but a null time."""
    rng = np.random.default_rng(4)
    us = np.cumsum(rng.choice([20_000_000, 90_000_000, 400_000_000, 9_000_000_000], 1500, p=[0.45, 0.4, 0.13, 0.02]))
    data = [(1, int(t), i, float(rng.integers(0, 100)), ["SAFE", "WARNING", "UNCERTAIN"][int(rng.integers(0, 3)) if i % 7 == 0 else i // 40 % 3], ["A", "B", None][i // 9 % 3]) for i, t in enumerate(us)]
    assert us[-1] > 64 * HOUR
    return spark.createDataFrame(data + [(2, 5, 9000, 50.0, "SAFE", None), (3, None, 9001, 99.0, "SAFE", None)], "worker long, us long, event_id long, value double, state string, reason string").repartition(7).persist()


def listed(rows):
    return sorted((r.asDict() for r in rows.where("worker = 1").collect()), key=lambda r: r["us"])


@pytest.mark.parametrize("slice_seconds", [3600, 10**7])
def test_scans_equal_loops(rows, slice_seconds):
    plain = listed(rows)
    got = listed(W.sessions(rows, 300, slice_seconds))
    session, want = 0, []
    for a, b in zip([None, *plain], plain):
        session += a is not None and b["us"] - a["us"] > 300_000_000
        want.append(session)
    assert [r["session"] for r in got] == want and want[-1] > 20

    got = listed(W.receipts(rows, 60, slice_seconds))
    since, want = 0, []
    for a, b in zip([None, *plain], plain):
        since = 1 if a is None or b["us"] - a["us"] > 60_000_000 else since + 1
        want.append((since, sum(b["us"] - 60_000_000 < x["us"] <= b["us"] for x in plain)))
    assert [(r["since_gap"], r["received"]) for r in got] == want

    got = listed(W.exposure(rows, F.col("value") >= 20, 120, slice_seconds))
    on, want = None, []
    for a, b in zip([None, *plain], plain):
        active = b["value"] >= 20
        on = (on + (b["us"] - a["us"]) / 1e6 if on is not None and b["us"] - a["us"] <= 120_000_000 else 1.0) if active else None
        want.append(on or 0.0)
    assert [r["exposure"] for r in got] == pytest.approx(want)

    got = sorted((r.episode, r.n) for r in W.episodes(rows, F.col("value") >= 50, slice_seconds).where("worker = 1").collect())
    runs = [len(x) for x in "".join("1" if r["value"] >= 50 else "0" for r in plain).split("0") if x]
    assert [n for _, n in got] == runs


@pytest.mark.parametrize("slice_seconds", [3600, 10**7])
def test_segments_and_live_points_equal_a_loop(rows, slice_seconds):
    graded = rows.withColumns({"quality": F.when(F.col("event_id") % 11 == 0, "IMPUTED").otherwise("VALID"), "confidence": F.when(F.col("event_id") % 5 > 0, F.col("value") / 100)})
    cut = 30 * HOUR
    whole = T.compressed(graded, 300, slice_seconds)
    merged = T.live(T.compressed(graded.where(F.col("us") < cut), 300, slice_seconds), graded, 300, slice_seconds)
    plain = listed(graded)
    segments = []
    for p in plain:
        why = (p["reason"] or "") if p["state"] == "UNCERTAIN" else None
        last = segments[-1] if segments else None
        if last and last["state"] == p["state"] and last["why"] == why and p["us"] - last["to"] <= 300_000_000:
            last["to"], last["n"] = p["us"], last["n"] + 1
        else:
            segments.append({"state": p["state"], "why": why, "from": p["us"], "to": p["us"], "n": 1})
    want = [(s["state"], s["why"] or None, s["from"], s["to"], s["n"]) for s in segments]
    for df in (whole, merged):
        got = [(r.state, r.reason or None, r.from_us, r.to_us, r.n) for r in sorted(df.where("worker = 1").collect(), key=lambda r: r.from_us)]
        assert got == want
    assert sorted(r.worker for r in merged.select("worker").distinct().collect()) == [1, 2]


def test_live_points_extend_only_the_last_segment_and_count_once(spark):
    seg = spark.createDataFrame([(1, 1, "SAFE", None, 0, 10_000_000, 3, 0.9, "VALID")], "worker long, segment long, state string, reason string, from_us long, to_us long, n long, confidence double, quality string")
    points = [(1, 5_000_000, 1, "SAFE", None, 0.1, "VALID"), (1, 12_000_000, 2, "SAFE", None, 0.5, "IMPUTED"), (1, 12_000_000, 3, "CRITICAL", None, 0.5, "VALID"), (1, 13_000_000, 4, None, None, 0.5, "VALID"), (1, 14_000_000, 5, "UNCERTAIN", "GAP", None, None), (2, 1, 6, "SAFE", None, None, "VALID")]
    df = spark.createDataFrame(points, "worker long, us long, event_id long, state string, reason string, confidence double, quality string")
    got = sorted(tuple(r) for r in T.live(seg, df, 5).collect())
    assert got == [(1, 1, "SAFE", None, 0, 12_000_000, 4, 0.8, "IMPUTED"), (1, 2, "UNCERTAIN", "GAP", 14_000_000, 14_000_000, 1, None, "UNCERTAIN"), (2, 1, "SAFE", None, 1, 1, 1, None, "VALID")]
    again = T.live(T.live(seg, df, 5), df, 5)
    assert sorted(tuple(r) for r in again.collect()) == got


def test_no_window_holds_a_workers_rows(rows):
    for df in (W.sessions(rows, 300), W.receipts(rows, 60), W.exposure(rows, F.col("value") > 1, 9), W.episodes(rows, F.col("value") > 1)):
        plan = df._jdf.queryExecution().analyzed().toString()
        alone = [x for x in plan.splitlines() if "windowspecdefinition(worker#" in x and "_slice" not in x.split("windowspecdefinition(")[1].split("ASC")[0] and " slice#" not in x]
        assert not alone, alone


def test_numbers_come_from_counts(spark):
    data = [(i % 2, float(i * 7919 % 50), i) for i in range(400)] + [(None, 1.0, 500), (0, None, 501)]
    df = spark.createDataFrame(data, "worker long, v double, k long").where("v is not null")
    got = {r.k: r.place for r in C.numbered(df, "worker", ["v", "k"], "place").collect()}
    for w in (0, 1, None):
        mine = sorted((v, k) for x, v, k in data if x == w and v is not None)
        assert [got[k] for _, k in mine] == list(range(len(mine)))


def test_stopping_blocks_are_the_middle_ones(spark):
    df = spark.createDataFrame([(1, i) for i in range(2100 * 2 - 50)], "worker long, event_id long")
    parts = {r.event_id: r.part for r in M.with_stopping_split(df, ["event_id"]).collect()}
    for i, part in parts.items():
        stop = i // 300 % 7 == 3
        near = any(0 <= j <= max(parts) and j // 300 % 7 == 3 for j in (i - 60, i + 60)) or any(j // 300 % 7 == 3 for j in range(max(0, i - 60), min(max(parts), i + 60), 20))
        assert part == ("stop" if stop else "purged" if near else "fit"), i
