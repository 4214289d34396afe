"""Rules on readings, model results and states, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearstream.functions.scalars import STATES, severity

#: What each data-quality reason is called, in words of our own.
REASON_TEXT = {
    "BASELINE_UNAVAILABLE": "no baselines are stored for this worker",
    "ML_SERVICE_UNAVAILABLE": "the classifier did not answer",
    "LOW_CONFIDENCE": "the classifier is not sure enough",
    "WORKER_NOT_FOUND": "nobody is known by this id",
    "BODY_CONTACT_FAILURE": "a body sensor has no contact",
    "SENSOR_UNAVAILABLE": "a channel has no usable value",
    "TOO_MANY_MISSING_SENSORS": "two or more channels have no usable value",
    "PACKET_LOSS": "too few samples arrived lately",
    "MAJOR_TIMESTAMP_GAP": "samples have just resumed after a pause",
    "OUT_OF_ORDER_TIMESTAMP": "a sample came after a later one",
    "UNSTABLE_HR": "the heart rate jumps about",
    "INVALID_PACKET": "a sample could not be read",
    "REQUIRED_FEATURES_UNAVAILABLE": "the classifier's inputs are incomplete",
    "SENSOR_WARMUP": "sensors are still heating up",
    "INSUFFICIENT_HISTORY": "the session has only begun",
    "GAS_BASELINE_UNAVAILABLE": "clean air is still being measured",
}


def looked_up(key: Column, texts: dict[str, str], otherwise: str) -> Column:
    """A key's text; the key itself where it has none; otherwise where there is no key."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.coalesce(key, F.lit("")))
    return F.coalesce(found, F.when(key != "", key), F.lit(otherwise))


def reason_text(reason: Column) -> Column:
    return looked_up(reason, REASON_TEXT, "unknown reason")


def transition_label(before: Column, now: Column) -> Column:
    return F.when(before.isNull(), F.concat(F.lit("Risk state: "), now)).otherwise(F.concat(F.lit("Risk changed: "), before, F.lit(" → "), now))


def aliased(record: Column, names: dict[str, list[str]]) -> list[Column]:
    """One column per name from a map of texts: the name's own entry, else the first alias that has one."""
    return [F.coalesce(*[F.try_element_at(record, F.lit(k)) for k in (name, *others)]).alias(name) for name, others in names.items()]


def parsed_reading(text: Column, fields: str) -> Column:
    """A JSON reading: its fields and problem, which is INVALID_PACKET where it can't be read or lacks worker or time."""
    r = F.from_json(text, f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.struct(r.alias("r"), F.when(r.isNull() | r["_bad"].isNotNull() | r["worker_id"].isNull() | r["timestamp"].isNull(), "INVALID_PACKET").alias("problem"))


def gas_ratio(gas: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, gas / baseline)


def is_number(text: Column) -> Column:
    """Whether a text is a finite number."""
    x = text.try_cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def mean_of(values: Column) -> Column:
    """Of an array; null for an empty one, nulls are left out."""
    v = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))


def median_of(values: Column) -> Column:
    """Of an array, the middle or the mean of the two middle values; null for an empty one, nulls are left out."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2.0)


def led_state(state: Column, uncertain: Column) -> Column:
    """What the lamp shows, emergencies aside: a warning or critical state, else UNCERTAIN for uncertain or unknown ones."""
    return F.when(state.isin("WARNING", "CRITICAL"), state).when(uncertain | state.isNull() | ~state.isin(*STATES), "UNCERTAIN").otherwise(state)


def raised(state: Column, backstop: Column) -> Column:
    """The more severe of a state and a backstop's verdict, which can raise but never lower it; a null one changes nothing."""
    return F.when(severity(backstop) > F.coalesce(severity(state), F.lit(-1)), backstop).otherwise(state)


def normalised(result: dict[str, Column], model: str, features: str) -> Column:
    """A model's answer as state, confidence, quality and reason; null where it is malformed or from another model.

    result has cls, ready, quality, reason, model, features (texts, boolean) and probabilities (a map by any case's
    label). An uncertain answer has its reason, UNSPECIFIED if it names none, and no confidence.
    """
    cls = F.upper(result["cls"])
    known = F.map_from_entries(F.filter(F.transform(F.map_entries(result["probabilities"]), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isin(*STATES) & e["value"].isNotNull() & ~F.isnan(e["value"])))
    good = cls.isin(*STATES) & (F.size(known) > 0) & result["ready"] & (result["model"] == model) & (result["features"] == features)
    text = F.lit(None).cast("string")
    return F.when(cls == "UNCERTAIN", F.struct(cls.alias("state"), F.lit(None).cast("double").alias("confidence"), F.lit("UNCERTAIN").alias("quality"), F.coalesce(result["reason"], F.lit("UNSPECIFIED")).alias("reason"))).when(
        good, F.struct(cls.alias("state"), F.try_element_at(known, cls).alias("confidence"), F.when(result["quality"] == "IMPUTED", "IMPUTED").otherwise("VALID").alias("quality"), text.alias("reason"))
    )


def missing(columns: dict[str, Column]) -> Column:
    """The names, in order, whose columns are null or NaN."""
    return F.filter(F.array(*[F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(n)) for n, c in columns.items()]), lambda x: x.isNotNull())


def recall_flag(recall: Column) -> Column:
    """How badly critical samples are missed: none found, under a quarter, under a half; else empty."""
    return F.when(recall == 0, "UNSAFE").when(recall < 0.25, "POOR").when(recall < 0.5, "LIMITED").otherwise("")


def outside(x: Column, bounds: dict[str, tuple[float, float]]) -> Column:
    """The first level, in order, whose bounds a value isn't within; FAULT for a missing one; null inside all of them."""
    out = F.when(x.isNull(), "FAULT")
    for level, (low, high) in bounds.items():
        out = out.when(~x.between(low, high), level)
    return out


def overall_state(emergency: Column, risk: Column, factors: Column, uncertain: Column) -> Column:
    """EMERGENCY, else the most severe of the risk and an array of factors' severities, else UNCERTAIN or UNKNOWN.

    Factors count only where they are a warning or critical.
    """
    rank = F.greatest(F.coalesce(severity(risk), F.lit(-1)), F.coalesce(F.array_max(F.transform(factors, lambda f: F.when(severity(f) > 0, severity(f)))), F.lit(-1)))
    return F.when(emergency, "EMERGENCY").when(rank >= 0, F.get(F.array(*[F.lit(s) for s in STATES]), rank)).when(uncertain, "UNCERTAIN").otherwise("UNKNOWN")


def wanted_toast(kind: Column, role: Column, preferences: dict[str, Column]) -> Column:
    """Whether a notification pops up: an emergency to an admin always, others as the user's preference for their kind says."""
    out = F.when((kind == "EMERGENCY") & (role == "ADMIN"), True)
    for name, preference in preferences.items():
        out = out.when(kind == name, F.coalesce(preference, F.lit(True)))
    return out.otherwise(False)
