"""Safety guidance: actions by rules, in order of priority, and sentences on a period's results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a channel's severity asks for, and the other rules: (key, priority); keys are names of our own but for noise.
CHANNEL_ACTIONS = {
    ("ambientTemperature", "CRITICAL"): ("moveToCoolerArea", "HIGH"),
    ("ambientTemperature", "WARNING"): ("hydrateAndRest", "MEDIUM"),
    ("noise", "CRITICAL"): ("reduceNoiseExposure", "HIGH"),
    ("noise", "WARNING"): ("monitorNoiseExposure", "MEDIUM"),
    ("gas", "CRITICAL"): ("leaveOrVentilateArea", "HIGH"),
    ("gas", "WARNING"): ("monitorGasLevel", "MEDIUM"),
    ("uv", "CRITICAL"): ("avoidDirectSun", "HIGH"),
    ("uv", "WARNING"): ("useSunProtection", "MEDIUM"),
}
CHECK_CONDITION = ("checkWorkerCondition", "MEDIUM")
COMMUNICATION_LOST = ("restoreCommunication", "MEDIUM")
REVIEW_SIGNAL = {"CRITICAL": ("checkWorkerCondition", "HIGH"), "WARNING": ("checkWorkerCondition", "MEDIUM")}
DATA_QUALITY = ("checkSensors", "MEDIUM")
ALL_SAFE = ("continueMonitoring", "LOW")
#: What an emergency asks of each role, in this order.
EMERGENCY = {"ADMIN": ["locateCheckWorker", "followEmergencyProcedure", "emergencyResetAfterCheck"], "WORKER": ["followEmergencyProcedure", "seekAssistance", "remainSafeLocation"]}
PRIORITIES = ["LOW", "MEDIUM", "HIGH"]
MOST = 5


def _action(pair: tuple[str, str], place: int) -> Column:
    return F.struct(F.lit(PRIORITIES.index(pair[1])).alias("rank"), F.lit(place).alias("place"), F.lit(pair[0]).alias("key"))


def actions(levels: dict[str, Column], attention: Column, online: Column, risk: Column, uncertain: Column, emergency: Column, viewer: Column | None = None) -> Column:
    """Up to five action keys, the most pressing first, equal ones in the rules' order; each key once, by its highest priority.

    An emergency has a list of its own for admins, and one for workers (viewer: ADMIN or else a worker). Otherwise: each channel's warning or critical level, a heart rate that needs
    attention, lost communication; a raised risk that none of these explain; doubtful data without a risk; and if there
    is nothing, to go on.
    """
    found, place = [], 0
    for (channel, level), pair in CHANNEL_ACTIONS.items():
        if channel in levels:
            place += 1
            found.append(F.when(levels[channel] == level, _action(pair, place)))
    found += [F.when(attention, _action(CHECK_CONDITION, 20)), F.when(~F.coalesce(online, F.lit(True)), _action(COMMUNICATION_LOST, 21))]
    given = F.filter(F.array(*found), lambda a: a.isNotNull())
    none = F.size(given) == 0
    more = [F.when(none & (risk == level), _action(pair, 22)) for level, pair in REVIEW_SIGNAL.items()]
    more.append(F.when(uncertain & risk.isNull(), _action(DATA_QUALITY, 23)))
    every = F.concat(given, F.filter(F.array(*more), lambda a: a.isNotNull()))
    every = F.when(F.size(every) == 0, F.array(_action(ALL_SAFE, 24))).otherwise(every)
    ordered = F.array_sort(F.transform(every, lambda a: F.struct((-a["rank"]).alias("rank"), a["place"].alias("place"), a["key"].alias("key"))))
    keys = F.slice(F.array_distinct(F.transform(ordered, lambda a: a["key"])), 1, MOST)
    urgent = {role: F.array(*[F.lit(k) for k in keys_]) for role, keys_ in EMERGENCY.items()}
    admin = F.coalesce((F.lit("WORKER") if viewer is None else viewer) == "ADMIN", F.lit(False))
    return F.when(emergency & admin, urgent["ADMIN"]).when(emergency, urgent["WORKER"]).otherwise(keys)


def summary_title(state: Column) -> Column:
    """What a guidance document is headed by, in words of our own."""
    titles = {"EMERGENCY": "Emergency", "CRITICAL": "Act now", "WARNING": "Take care", "SAFE": "All as it should be", "UNCERTAIN": "Not certain", "NO_HELMET": "No helmet", "NO_DATA": "No readings yet"}
    out = F.when(F.lit(False), "")
    for name, title in titles.items():
        out = out.when(state == name, title)
    return out.otherwise("Not known yet")


def summary_text(state: Column, attention: Column, reason: Column, viewer: Column) -> Column:
    """One sentence below the title; a warning or critical state always names at least one condition. viewer: ADMIN or a worker."""
    whom = F.when(viewer == "ADMIN", "this worker").otherwise("you")
    n = F.greatest(attention, F.lit(1))
    conditions = F.when(n == 1, "1 condition needs ").otherwise(F.concat(n.cast("string"), F.lit(" conditions need ")))
    return (
        F.when(state == "EMERGENCY", F.concat(F.lit("An emergency is on for "), whom, F.lit(".")))
        .when(state == "CRITICAL", F.concat(conditions, F.lit("attention at once.")))
        .when(state == "WARNING", F.concat(conditions, F.lit("attention.")))
        .when(state == "SAFE", "The readings are in their usual ranges.")
        .when(state == "UNCERTAIN", F.concat(F.lit("The risk for "), whom, F.lit(" can't be told now: "), reason, F.lit(". It may not be safe.")))
        .when(state == "NO_HELMET", "Guidance begins when a helmet is assigned.")
        .when(state == "NO_DATA", "Guidance begins with the first readings.")
        .otherwise("No state has been found yet.")
    )


def insights(alerts: Column, before: Column, worst_hour: Column, coverage: Column) -> Column:
    """Sentences on a period, in order; without alerts and coverage there are none."""
    change = F.when(alerts > before, "more").when(alerts < before, "fewer")
    text = F.filter(
        F.array(
            F.when(change.isNotNull(), F.concat(F.format_string("%d alerts, %d ", alerts, F.abs(alerts - before)), change, F.lit(" than before."))).otherwise(F.format_string("%d alerts, as many as before.", alerts)),
            F.when(worst_hour.isNotNull(), F.format_string("Most critical alerts were at %02d:00.", worst_hour)),
            F.when(coverage < 90, F.format_string("Only %.1f %% of the expected samples came in.", coverage)),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when((alerts > 0) | coverage.isNotNull(), text).otherwise(F.array().cast("array<string>"))
