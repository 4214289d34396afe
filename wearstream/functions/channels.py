"""The site channels' ranges and levels, and the factors of a reading that guidance rests on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearstream.functions.scalars import deviation_percent, half_up

#: A channel's first warning value, its last one, and whether a value equal to the last still is a warning.
RANGES = {"ambientTemperature": (27.0, 35.0, True), "noise": (80.0, 85.0, False), "gas": (150.0, 300.0, True), "uv": (3.0, 8.0, True)}
#: Fixed value: how many factors a guidance document shows.
MOST_FACTORS = 4


def finite(x: Column) -> Column:
    """A number, or null for NaN and infinities."""
    v = x.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def channel_level(channel: str, x: Column) -> Column:
    """SAFE, WARNING or CRITICAL by the channel's ranges; null without a finite number."""
    first, last, inclusive = RANGES[channel]
    v = finite(x)
    within = (v <= last) if inclusive else (v < last)
    return F.when(v < first, "SAFE").when(within, "WARNING").when(v.isNotNull(), "CRITICAL")


def _factor(name: str, severity: Column, value: Column, detail: Column, attention: Column) -> Column:
    return F.struct(F.lit(name).alias("factor"), severity.alias("severity"), value.alias("value"), detail.alias("detail"), attention.alias("attention"))


def _beside_baseline(x: Column, baseline: Column) -> tuple[Column, Column]:
    """How far a value is from its baseline in percent, and that in words with one digit."""
    percent = deviation_percent(finite(x), finite(baseline))
    side = F.when(percent >= 0, " % over the baseline").otherwise(" % under the baseline")
    return percent, F.concat(F.format_string("%.1f", half_up(F.abs(percent), 1)), side)


def factors(channels: dict[str, Column], heart: tuple[Column, Column], body: tuple[Column, Column], online: Column, attention_percent: float) -> Column:
    """An array of a reading's factors (factor, severity, value, detail, attention), criticals first, then warnings, then INFO.

    Site channels count only where they are a warning or critical. Heart rate and body temperature (value, baseline) are
    INFO with their deviation in words, and left out without a value or a baseline above 0; a heart rate at least
    attention_percent off needs attention. A helmet that isn't online is a warning; one never seen (null) is not. Equal
    severities keep the order of RANGES, then heart rate, body temperature, communication. Values have one digit.
    """
    no = F.lit(False)
    found = []
    for name in (c for c in RANGES if c in channels):
        level = channel_level(name, channels[name])
        detail = F.when(level == "CRITICAL", "in the critical range").otherwise("in the warning range")
        found.append(F.when(level.isin("WARNING", "CRITICAL"), _factor(name, level, half_up(finite(channels[name]), 1), detail, no)))
    for name, (x, baseline), limit in (("heartRate", heart, attention_percent), ("bodyTemperature", body, None)):
        percent, words = _beside_baseline(x, baseline)
        found.append(F.when(percent.isNotNull(), _factor(name, F.lit("INFO"), half_up(finite(x), 1), words, no if limit is None else F.abs(percent) >= limit)))
    found.append(F.when(~online, _factor("helmetCommunication", F.lit("WARNING"), F.lit(None).cast("double"), F.lit("nothing is heard from the helmet"), no)))
    given = F.array_compact(F.array(*found))
    by = lambda level: F.filter(given, lambda f: f["severity"] == level)
    return F.concat(by("CRITICAL"), by("WARNING"), by("INFO"))


def attention_count(found: Column) -> Column:
    """How many factors are a warning, critical, or need attention."""
    return F.size(F.filter(found, lambda f: (f["severity"] != "INFO") | f["attention"]))
