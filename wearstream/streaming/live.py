"""From readings to confirmed states on a stream or a table: handovers by helmet, features by worker, a model, then votes and alerts.

Each stage keeps its state by its own key, so on a stream they are chained stateful operators of one query, and a
trigger's rows pass all of them. On a table the same folds replay the rows in order of seq.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearstream.streaming.keyed import Fold, fold
from wearstream.streaming.quality import COLUMNS, FEATURES, Issues, Rules, live_features

LEVELS = ["SAFE", "WARNING", "CRITICAL"]


class Owners(Fold):
    """Who wears a helmet: a row for each reading, and before it one for the last wearer where that changes."""

    states = {"owner": "worker long"}

    def begin(self, stored: dict) -> dict:
        return stored.get("owner") or {"worker": None}

    def step(self, now: dict, row: dict) -> list[tuple]:
        before, now["worker"] = now["worker"], row["worker"]
        reading = tuple(row[c] for c in PASSED)
        if before is None or before == row["worker"]:
            return [reading]
        ended = {c: None for c in PASSED} | {"worker": before, "seq": row["seq"], "us": row["us"], "workday": row["workday"], "control": "handover"}
        return [tuple(ended.values()), reading]

    def end(self, now: dict) -> dict:
        return {"owner": now}


PASSED = ["worker", *[c for c in COLUMNS if c != "helmet"]]


def handovers(readings: DataFrame) -> DataFrame:
    """Readings (worker and COLUMNS) with a control row for the last wearer where a helmet comes to another worker.

    State is by helmet, so it works on a stream, and the rows are those of `quality.handed_over` on a table. Rows
    without a helmet pass by.
    """
    kinds = {f.name: f.dataType.simpleString() for f in readings.schema}
    given = readings.select("worker", *COLUMNS).where("helmet is not null and worker is not null")
    seq_first = ["seq", "worker", *[c for c in PASSED if c not in ("seq", "worker")]]
    worn = fold(given, "helmet", seq_first, ", ".join(f"{c} {kinds[c]}" for c in ("helmet", *PASSED)), Owners())
    worn = worn.withColumn("helmet", F.when(F.col("control").isNull(), F.col("helmet")))
    return worn.select("worker", *COLUMNS).unionByName(readings.where("helmet is null or worker is null").select("worker", *COLUMNS))


def scored(features: DataFrame, model: PipelineModel | None, labels: list[str] = LEVELS) -> DataFrame:
    """Rows of `live_features` with predicted (a label), confidence and probabilities by label; null unless the row is READY.

    model takes the features by name and gives prediction and probability, as `training.fit` makes them. Without a model
    READY rows have no result, for the reason ML_SERVICE_UNAVAILABLE.
    """
    if model is None:
        none = {"predicted": "string", "confidence": "double", "probabilities": "map<string,double>"}
        why = F.when(F.col("status") == "READY", F.array(F.lit("ML_SERVICE_UNAVAILABLE"))).otherwise(F.col("reasons"))
        return features.withColumn("reasons", why).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    out = model.transform(features)
    ready = F.col("status") == "READY"
    found = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in labels])
    given = features.columns
    return out.select(
        *[F.col(f"`{c}`") for c in given], F.when(ready, F.element_at(names, F.col("prediction").cast("int") + 1)).alias("predicted"),
        F.when(ready, F.array_max(found)).alias("confidence"), F.when(ready, F.map_from_arrays(names, found)).alias("probabilities"),
    )


@dataclass(frozen=True)
class Decisions:
    """The least confidence that counts, how many accepted results vote, and the alerts' clock."""

    confidence: float = 0.7
    votes: int = 5
    rules: Rules = Rules()


RESULTS = ["seq", "us", "session", "status", "reasons", "predicted", "confidence", "backstop"]
STATES_OUT = (
    "worker long, seq long, us long, session long, state string, reason string, confidence double, smoothed string, confirmed string, changed_from string, changed_to string, "
    "alert boolean, alert_reason string, alert_since long"
)


class Votes(Fold):
    """A worker's votes, confirmed state and issue clock."""

    states = {"risk": "session long, votes array<int>, confirmed string, issue long, alerted boolean, last_alert long"}

    def __init__(self, limits: Decisions):
        self.limits = limits

    def begin(self, stored: dict) -> dict:
        return stored.get("risk") or {"session": None, "votes": [], "confirmed": None, "issue": None, "alerted": False, "last_alert": None}

    def end(self, now: dict) -> dict:
        return {"risk": now}

    def judged(self, row: dict) -> tuple[str | None, list[str]]:
        """The level that counts, or why none does. A backstop counts where it is more severe or nothing else counts."""
        level, why = row["predicted"], list(row["reasons"] or [])
        if row["status"] != "READY" or level is None:
            level, why = None, why or ["INVALID_RESULT"]
        elif (row["confidence"] or 0.0) < self.limits.confidence:
            level, why = None, ["LOW_CONFIDENCE"]
        raised = row["backstop"]
        if raised in LEVELS and (level is None or LEVELS.index(raised) > LEVELS.index(level)):
            level, why = raised, []
        return level, why

    def voted(self, now: dict, level: str) -> str:
        """The level that most of the last accepted results have; of equally many the more severe."""
        now["votes"] = [*now["votes"], LEVELS.index(level)][-self.limits.votes :]
        return LEVELS[max(set(now["votes"]), key=lambda v: (now["votes"].count(v), v))]

    def step(self, now: dict, row: dict) -> tuple:
        if row["session"] is not None and row["session"] != now["session"]:
            now |= {"session": row["session"], "votes": [], "confirmed": None}
        level, why = self.judged(row)
        smoothed = before = after = None
        if level is not None:
            smoothed, before = self.voted(now, level), now["confirmed"]
            if smoothed != before and (before is not None or smoothed != LEVELS[0]):
                after = smoothed
            now["confirmed"] = smoothed
        since = now["issue"]
        alert = Issues(now, self.limits.rules).alert(row["us"], why)
        issue = next((x for x in why if x not in ("SENSOR_WARMUP", "INSUFFICIENT_HISTORY", "GAS_BASELINE_UNAVAILABLE")), None) if alert else None
        moved = (before if after else None, after)
        return row["seq"], row["us"], row["session"], level or "UNCERTAIN", why[0] if why else None, row["confidence"], smoothed, now["confirmed"], *moved, alert, issue, since if alert else None


def states(results: DataFrame, limits: Decisions = Decisions()) -> DataFrame:
    """Scored rows (worker and RESULTS; backstop may be missing) with system and confirmed states, transitions, and alerts.

    A result counts if its row is READY and its confidence high enough, else the row is UNCERTAIN with its first reason
    or LOW_CONFIDENCE. The last counted results of a session vote; ties go to the more severe. The vote is the confirmed
    state; changed_from and changed_to tell where it changes, but that a session begins SAFE is no event. A new session
    clears votes and confirmed state. alert tells that issues other than warming up have lasted (see
    `quality.Issues`), alert_since from when; a row that counts ends the episode.
    """
    given = results if "backstop" in results.columns else results.withColumn("backstop", F.lit(None).cast("string"))
    return fold(given, "worker", RESULTS, STATES_OUT, Votes(limits))


def live_states(readings: DataFrame, model: PipelineModel | None, rules: Rules = Rules(), limits: Decisions = Decisions(), backstop: Column | None = None) -> DataFrame:
    """Readings to states: handovers, features, the model's results on READY rows, and `states` of them."""
    results = scored(live_features(handovers(readings), rules), model)
    kept = results.select("worker", *RESULTS[:-1], (F.lit(None).cast("string") if backstop is None else backstop).alias("backstop"))
    return states(kept, limits)


def transitions(decided: DataFrame) -> DataFrame:
    """The events of `states`: changes of the confirmed state, and data-quality alerts."""
    kind = F.when(F.col("changed_to").isNotNull(), "RISK_STATE").otherwise("DATA_QUALITY")
    return decided.where("changed_to is not null or alert").select("worker", "seq", "us", "session", kind.alias("kind"), "changed_from", "changed_to", "alert_reason", "alert_since")


def trained_features() -> list[str]:
    """The features in the order that models take them."""
    return list(FEATURES)
