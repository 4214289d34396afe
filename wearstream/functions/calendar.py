"""Periods of the site's calendar: days, weeks from Monday, months, as half-open ranges of UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearstream.functions.scalars import SITE_OFFSET_MINUTES, site_time

#: Fixed value: the kinds of period.
PERIODS = ["daily", "weekly", "monthly"]
SITE_ZONE = "Asia/Colombo"


def checked_date(text: Column) -> Column:
    """The date that a text in the form YYYY-MM-DD names; null for other forms and impossible dates."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def checked_period(kind: Column) -> Column:
    return F.when(kind.isin(*PERIODS), kind)


def first_day(kind: Column, day: Column) -> Column:
    """A period's first local day."""
    return F.when(kind == "weekly", F.trunc(day, "week")).when(kind == "monthly", F.trunc(day, "month")).when(kind == "daily", day)


def next_first_day(kind: Column, first: Column) -> Column:
    return F.when(kind == "weekly", F.date_add(first, 7)).when(kind == "monthly", F.add_months(first, 1)).when(kind == "daily", F.date_add(first, 1))


def earlier_first_day(kind: Column, first: Column) -> Column:
    return F.when(kind == "weekly", F.date_sub(first, 7)).when(kind == "monthly", F.add_months(first, -1)).when(kind == "daily", F.date_sub(first, 1))


def site_midnight(day: Column) -> Column:
    """The UTC instant, without zone, at which a local day begins."""
    return day.cast("timestamp_ntz") - F.expr(f"interval '{SITE_OFFSET_MINUTES}' minute")


def label_of(kind: Column, first: Column) -> Column:
    """2024-01-31; 2024-01-29 to 2024-02-04; 2024-01."""
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return F.when(kind == "weekly", F.concat(day(first), F.lit(" to "), day(F.date_add(first, 6)))).when(kind == "monthly", F.date_format(first, "yyyy-MM")).when(kind == "daily", day(first))


def boundaries(kind: Column, day: Column) -> Column:
    """start and end of the period that holds a local day, and of the one before, with their labels; end is exclusive."""
    first = first_day(kind, day)
    earlier = earlier_first_day(kind, first)
    return F.struct(
        site_midnight(first).alias("start"), site_midnight(next_first_day(kind, first)).alias("end"), label_of(kind, first).alias("label"),
        site_midnight(earlier).alias("previous_start"), site_midnight(first).alias("previous_end"), label_of(kind, earlier).alias("previous_label"),
    )


def within(ts: Column, start: Column, end: Column) -> Column:
    """Whether an instant is in [start, end)."""
    return (ts >= start) & (ts < end)


def buckets(kind: Column, day: Column) -> Column:
    """Labels of a period's buckets in order: 24 hours of a day, or the days of a week or month."""
    first = first_day(kind, day)
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00")))
    days = F.transform(F.sequence(first, F.date_sub(next_first_day(kind, first), 1)), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return F.when(kind == "daily", hours).otherwise(days)


def bucket_of(kind: Column, ts: Column) -> Column:
    """The bucket label of an instant."""
    local = site_time(ts)
    return F.when(kind == "daily", F.concat(F.lpad(F.hour(local).cast("string"), 2, "0"), F.lit(":00"))).otherwise(F.date_format(local, "yyyy-MM-dd"))


def offset_minutes(ts: Column, zone: str = SITE_ZONE) -> Column:
    """A zone's distance from UTC at an instant without zone."""
    there = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    return ((F.unix_micros(there.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 60_000_000).cast("int")


def since(ts: Column, now: Column) -> Column:
    """How long ago, in words: minutes below an hour, hours below a day, then days."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 60_000_000)
    hours = F.floor(minutes / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, "just now").when(minutes < 60, text(minutes, " min ago")).when(hours < 24, text(hours, " hr ago")).otherwise(text(F.floor(hours / 24), " d ago"))


def site_iso(ts: Column) -> Column:
    """Local ISO 8601 time with milliseconds and the site's offset."""
    sign, size = "+" if SITE_OFFSET_MINUTES >= 0 else "-", abs(SITE_OFFSET_MINUTES)
    return F.concat(F.date_format(site_time(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(f"{sign}{size // 60:02d}:{size % 60:02d}"))


def instant(text: Column) -> Column:
    """The instant of an ISO time: by its offset, or as the site's wall clock where it has none; null for other texts.

    It doesn't depend on the session's zone.
    """
    sign, size = "+" if SITE_OFFSET_MINUTES >= 0 else "-", abs(SITE_OFFSET_MINUTES)
    seconds = F.when(text.rlike(r"[T ]\d{2}:\d{2}$"), ":00").otherwise("")
    at_site = F.concat(text, seconds, F.lit(f"{sign}{size // 60:02d}:{size % 60:02d}"))
    timed = text.rlike(r"[T ]\d{2}:\d{2}")
    return F.try_to_timestamp(F.when(text.rlike(r"[T ]\d{2}:.*(Z|[+-]\d{2}(:?\d{2})?)$"), text).when(timed, at_site))


def parsed_time(text: Column) -> Column:
    """Of an ISO time: epoch seconds (see `instant`), and the date and hour as the text has them; null for other texts.

    The offset is the text's own, or else the site's, so the local date is the sender's.
    """
    found = instant(text)
    local = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2})", 0)
    return F.when(
        found.isNotNull() & (local != ""),
        F.struct((F.unix_micros(found) / 1e6).alias("epoch"), F.substring(local, 1, 10).cast("date").alias("local_date"), F.substring(local, 12, 2).cast("int").alias("local_hour")),
    )
