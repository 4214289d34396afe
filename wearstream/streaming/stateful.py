"""Keyed state per worker: emergencies, and the gate that decides which samples may be classified.

Both take rows in the order of `seq` (the order of receipt); nothing is dropped for being late. State is a few numbers per
worker. A table is replayed in the order of all its rows, whatever its files: a worker's rows are sorted by Spark and read
batch by batch, so a task holds one batch. In a stream, triggers are taken as they come and a trigger's rows of a worker
are sorted, so a trigger's size bounds what a worker's task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EMERGENCY_OUT = "worker long, seq long, us long, phase string, outcome string"
GATE_OUT = "worker long, seq long, us long, session long, status string, reason string, alert boolean"

#: Reasons from the most to the least pressing, and those that belong to warming up.
OUT_OF_ORDER, COLD_START, FEW_SAMPLES, REFILL, NO_VALUE = "OUT_OF_ORDER_TIMESTAMP", "SENSOR_WARMUP", "INSUFFICIENT_HISTORY", "MAJOR_TIMESTAMP_GAP", "SENSOR_UNAVAILABLE"
WARMING = {COLD_START, FEW_SAMPLES}


def folded(rows: DataFrame, columns: list[str], out: str, state: str, start: tuple, step: Callable[[dict, tuple], tuple | None], close: Callable[[dict], None] | None = None) -> DataFrame:
    """step(state, row) of each row of a worker in order of seq, with the state that the row before left; None gives no row.

    Equal seqs are taken in order of the other columns in a table, in order of arrival in a stream. close brings the
    state into its stored form at the end of a trigger.
    """
    names, given = [c.split()[0] for c in state.split(", ")], rows.select("worker", *columns)
    schema = to_arrow_schema(StructType.fromDDL(out))

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*found) if found else [[]] * len(schema), schema)], schema=schema)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = (), {}
        for batch in batches:
            found = []
            for worker, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (worker,) != now:
                    now, s = (worker,), dict(zip(names, start))
                out_row = step(s, row)
                if out_row is not None:
                    found.append((worker, *out_row))
            yield table(found)

    def trigger(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, held.get if held.exists else start))
        frame = pd.concat(frames).sort_values("seq", kind="stable")
        found = [(key[0], *out_row) for row in zip(*(_plain(frame[c]) for c in columns)) if (out_row := step(s, row)) is not None]
        if close:
            close(s)
        held.update(tuple(s[n] for n in names))
        yield table(found).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    if given.isStreaming:
        return given.groupBy("worker").applyInPandasWithState(trigger, out, state, "append", GroupStateTimeout.NoTimeout)
    return given.repartition("worker").sortWithinPartitions("worker", *columns).mapInArrow(replay, out)


def _plain(column: pd.Series) -> list:
    """A column's values as Python's own, null ones as None."""
    return [None if x is None or x is pd.NA or x != x else x for x in column.tolist()]


def emergencies(actions: DataFrame) -> DataFrame:
    """Each action (worker, seq, us, action) with the phase after it and its outcome.

    A press activates, or only refreshes an active emergency; a request asks for a reset of an active one, is repeated
    without effect and is refused without one; an ack ends a requested reset and is otherwise stale. Other or null
    actions are ignored. Risk states aren't touched.
    """

    def step(phase: str, action: str | None) -> tuple[str, str]:
        if action == "press":
            return ("active", "activated") if phase == "inactive" else (phase, "refreshed")
        if action == "request":
            return {"inactive": ("inactive", "refused"), "active": ("reset_requested", "requested")}.get(phase, (phase, "repeated"))
        if action == "ack":
            return ("inactive", "resolved") if phase == "reset_requested" else (phase, "stale")
        return phase, "ignored"

    def row(s: dict, row: tuple) -> tuple:
        seq, us, action = row
        s["phase"], outcome = step(s["phase"], action)
        return seq, us, s["phase"], outcome

    return folded(actions, ["seq", "us", "action"], EMERGENCY_OUT, "phase string", ("inactive",), row)


@dataclass(frozen=True)
class Limits:
    """The gate's limits, in seconds or samples."""

    session_gap: float = 1800.0
    cold_after: float = 4 * 3600.0
    cold_warmup: float = 180.0
    least_samples: int = 20
    refill_gap: float = 10.0
    alert_after: float = 30.0
    alert_pause: float = 600.0


STATE = "last long, workday long, session long, began long, samples long, since_gap long, refill boolean, cold boolean, ended long, issue long, alerted boolean, last_alert long"


def gate(samples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each sample (worker, seq, us, workday, value) with its session, READY or UNCERTAIN, the first reason, and alerts.

    A sample no later than the last is OUT_OF_ORDER_TIMESTAMP, has no session and leaves the sessions' state alone. A new
    workday or a long gap ends a session; the first of a workday, or one long after the last, starts cold. Gaps ask for
    a refill. A null value is SENSOR_UNAVAILABLE. An alert is raised once in an episode of UNCERTAIN samples when issues
    other than warming up have lasted alert_after, and alert_pause after the worker's last one.
    """

    def row(s: dict, row: tuple) -> tuple:
        seq, us, day, value = row
        us, day = int(us), int(day)
        if s["last"] is not None and us <= s["last"]:
            session, reason = None, OUT_OF_ORDER
        else:
            session, reason = _admitted(s, us, day, None if pd.isna(value) else float(value), limits)
        return seq, us, session, "UNCERTAIN" if reason else "READY", reason, _alert(s, us, reason, limits)

    start = {"session": 0, "alerted": False}
    return folded(samples, ["seq", "us", "workday", "value"], GATE_OUT, STATE, tuple(start.get(c.split()[0]) for c in STATE.split(", ")), row)


def _admitted(s: dict, us: int, day: int, value: float | None, limits: Limits) -> tuple[int, str | None]:
    new_day = s["workday"] is not None and s["workday"] != day
    gap = None if s["last"] is None else (us - s["last"]) / 1e6
    if gap is None or new_day or gap > limits.session_gap:
        ended = s["last"]
        s |= {"session": s["session"] + 1, "began": us, "samples": 0, "since_gap": 0, "refill": False}
        s["cold"] = ended is None or new_day or (us - ended) / 1e6 >= limits.cold_after
        s["ended"] = ended
    elif gap > limits.refill_gap:
        s |= {"refill": True, "since_gap": 0}
    s |= {"last": us, "workday": day, "samples": s["samples"] + 1, "since_gap": s["since_gap"] + 1}
    if s["refill"] and s["since_gap"] >= limits.least_samples:
        s["refill"] = False
    if s["cold"] and (us - s["began"]) / 1e6 < limits.cold_warmup:
        return s["session"], COLD_START
    if s["samples"] < limits.least_samples:
        return s["session"], FEW_SAMPLES
    if s["refill"]:
        return s["session"], REFILL
    return s["session"], NO_VALUE if value is None else None


def _alert(s: dict, us: int, reason: str | None, limits: Limits) -> bool:
    if reason is None:
        s |= {"issue": None, "alerted": False}
        return False
    if reason in WARMING:
        s["issue"] = None
        return False
    if s["issue"] is None:
        s["issue"] = us
    due = (us - s["issue"]) / 1e6 >= limits.alert_after and not s["alerted"]
    if due and (s["last_alert"] is None or (us - s["last_alert"]) / 1e6 >= limits.alert_pause):
        s |= {"alerted": True, "last_alert": us}
        return True
    return False
