"""Scalar rules on channels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from low to high, and the site's offset from UTC in minutes.
STATES = ["SAFE", "WARNING", "CRITICAL"]
SITE_OFFSET_MINUTES = 330


def cleaned(x: Column) -> Column:
    """A channel's number, or null for the -1 sentinel, NaN and infinities."""
    v = x.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")) | (v == -1), None).otherwise(v)


def half_up(x: Column, digits: int) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def percent_change(now: Column, before: Column) -> Column:
    """0 where both are 0, null where only the earlier is, else in percent with one digit."""
    return F.when((before == 0) & (now == 0), 0.0).when(before != 0, half_up((now - before) / F.abs(before) * 100.0, 1))


def deviation(x: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, x - baseline)


def deviation_percent(x: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (x - baseline) / baseline * 100.0)


def noise_dose(level: Column, seconds: Column) -> Column:
    """Share in percent of the allowed daily noise that seconds at a level use up; none below 80 dB."""
    return F.when(level < 80, 0.0).otherwise(100.0 * (seconds / 60.0) / (480.0 / F.pow(F.lit(2.0), (level - 85.0) / 3.0)))


def classified(x: Column, warning: float, critical: float) -> Column:
    return F.when(x >= critical, "CRITICAL").when(x >= warning, "WARNING").when(x.isNotNull(), "SAFE")


def severity(state: Column) -> Column:
    """0 to 2; null for other states."""
    return F.when(state == "SAFE", 0).when(state == "WARNING", 1).when(state == "CRITICAL", 2)


def confident(state: Column, confidence: Column, least: float = 0.7) -> Column:
    return F.when(confidence < least, "UNCERTAIN").otherwise(state)


def site_time(ts: Column) -> Column:
    return ts + F.expr(f"interval '{SITE_OFFSET_MINUTES}' minute")


def alert_kind(event_type: Column) -> Column:
    return F.when(event_type == "click", "WARNING").when(event_type == "purchase", "CRITICAL").when(event_type == "error", "EMERGENCY").when(event_type == "view", "SAFE").otherwise("DATA_QUALITY")


def gps(lat: Column, lon: Column) -> Column:
    """A position, or null outside the globe."""
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def plausibility(x: Column, low: float, high: float, no_contact: Column | None = None) -> Column:
    """MISSING, NO_CONTACT or OUT_OF_RANGE, whichever comes first; null for a good value."""
    missing = F.when(x.isNull(), "MISSING")
    return (missing if no_contact is None else missing.when(no_contact, "NO_CONTACT")).when(~x.between(low, high), "OUT_OF_RANGE")


def equivalent_level(level: Column) -> Column:
    """An aggregate: the steady level in dB with the same energy."""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), level / 10)))


def operational_state(emergency: Column, state: Column, uncertain: Column) -> Column:
    """EMERGENCY first; WARNING and CRITICAL outlast uncertainty; then UNCERTAIN, the state, UNKNOWN."""
    return F.when(emergency, "EMERGENCY").when(state.isin("WARNING", "CRITICAL"), state).when(uncertain, "UNCERTAIN").otherwise(F.coalesce(state, F.lit("UNKNOWN")))


def online(last_seen: Column, now: Column, seconds: int = 180) -> Column:
    """Null where never seen."""
    return F.when(last_seen.isNotNull(), F.unix_micros(now) - F.unix_micros(last_seen) <= seconds * 1_000_000)


def workday(local: Column, boundary_hour: int) -> Column:
    """The local date of a shift; hours before the boundary belong to the day before."""
    return F.date_sub(local.cast("date"), (F.hour(local) < boundary_hour).cast("int"))


def signature(counters: dict[str, Column], none: str = "(none)") -> Column:
    """The names of the counters above zero, joined by a plus."""
    text = F.concat_ws(" + ", *[F.when(c > 0, name) for name, c in counters.items()])
    return F.when(text == "", none).otherwise(text)


def contains(text: str, *columns: Column) -> Column:
    """Whether any column has the text, in any case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return found
