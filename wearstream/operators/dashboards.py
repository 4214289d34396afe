"""Whole views: the admin's and the workers' dashboards, a period's summary, prediction histories, guidance documents.

Each is a dictionary of small tables, one for each of the view's parts; `assembled` makes one long table of them. What
is per worker is grouped by worker, so parts grow with workers, never with readings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, TimestampNTZType, TimestampType

from wearstream.functions import calendar as C
from wearstream.functions import channels as N
from wearstream.functions import guidance as G
from wearstream.functions.results import overall_state, reason_text
from wearstream.functions.scalars import half_up, online, operational_state, percent_change, site_time
from wearstream.operators import aggregates as A
from wearstream.operators import joins as J
from wearstream.operators import periods as P
from wearstream.operators import sites as T
from wearstream.operators import timelines as L


def assembled(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One long table (part, item, name, number, text) of parts (rows, key columns).

    A row's item is its keys joined by a slash, a null one as nothing; each other column is a row with its name.
    Numbers, booleans (1, 0) and times (microseconds) stand under number, all else under text.
    """

    def long(part: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        def pair(field):
            c, kind = F.col(f"`{field.name}`"), field.dataType
            if isinstance(kind, (TimestampType, TimestampNTZType)):
                c = F.unix_micros(c.cast("timestamp"))
            is_number = isinstance(kind, (NumericType, BooleanType, TimestampType, TimestampNTZType))
            number = (c.cast("int") if isinstance(kind, BooleanType) else c).cast("double") if is_number else F.lit(None).cast("double")
            return F.struct(F.lit(field.name).alias("name"), number.alias("number"), F.lit(None).cast("string").alias("text") if is_number else c.cast("string").alias("text"))

        item = F.concat_ws("/", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])
        values = [pair(f) for f in rows.schema.fields if f.name not in keys]
        return rows.select(F.lit(part).alias("part"), item.alias("item"), F.inline(F.array(*values)))

    return reduce(DataFrame.unionByName, [long(part, rows, keys) for part, (rows, keys) in parts.items()])


def newest(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Each key's newest rows with their place from 1; ties by id. Tasks keep only that many of a key before the exchange."""
    by = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top)


def standing(workers: DataFrame, states: DataFrame, emergencies: DataFrame) -> DataFrame:
    """Every worker's operational state, and why where it is UNCERTAIN. states: worker, state, uncertain, reason, one row each."""
    on = emergencies.select(F.col("worker").alias("_e")).distinct()
    joined = workers.join(states.withColumnRenamed("worker", "_w"), F.col("worker_id") == F.col("_w"), "left").join(on, F.col("worker_id") == F.col("_e"), "left")
    state = operational_state(F.col("_e").isNotNull(), F.col("state"), F.coalesce("uncertain", F.lit(False)))
    return joined.select("worker_id", "name", state.alias("state"), F.when(state == "UNCERTAIN", F.col("reason")).alias("reason"))


def admin_dashboard(workers: DataFrame, helmets: DataFrame, packets: DataFrame, alerts: DataFrame, states: DataFrame, emergencies: DataFrame, now: str, *, seconds: int, top: int = 10, days: int = 7) -> dict:
    """All of the admin's first page: summary, workers by state, helmets, alerts of the local day, the newest ones, locations.

    Only workers with an active helmet and a valid position have a location; with no position none is made up.
    """
    at = F.lit(now).cast("timestamp_ntz")
    stands = standing(workers, states, emergencies)
    counted = J.state_counts(workers, stands.select(F.col("worker_id").alias("worker"), F.col("state").alias("latest")))
    on = T.helmet_summary(helmets, T.last_seen(packets, "worker"), at, seconds)
    start = C.site_midnight(site_time(at).cast("date"))
    today = alerts.where(C.within(F.col("ts"), start, start + F.expr("interval '1' day"))).agg(F.count("*").alias("alerts_today"))
    heads = counted.agg(F.coalesce(F.sum("workers"), F.lit(0)).alias("workers"), F.coalesce(F.sum(F.when(F.col("state") == "SAFE", F.col("workers"))), F.lit(0)).alias("safe"))
    summary = heads.crossJoin(today).crossJoin(on.select("online"))  # one row each
    placed = T.locations(workers, helmets, packets, stands.select(F.col("worker_id").alias("worker"), "state"))
    why = stands.select(F.col("worker_id").alias("_w"), "name", "reason")
    when = packets.where("gps is not null").groupBy(F.col("worker").alias("_p")).agg(F.max("ts").alias("position_at"))
    placed = placed.join(why, F.col("worker_id") == F.col("_w")).join(when, F.col("worker_id") == F.col("_p")).drop("_w", "_p").withColumn("online", online(F.col("seen").cast("timestamp"), at.cast("timestamp"), seconds))
    recent = P.recent(alerts, now, days=days, top=top)
    return {"summary": (summary, []), "workers": (counted, ["state"]), "helmets": (on, []), "alerts": (recent, ["event_id"]), "locations": (placed, ["worker_id"])}


def worker_dashboards(workers: DataFrame, helmets: DataFrame, packets: DataFrame, alerts: DataFrame, states: DataFrame, emergencies: DataFrame, now: str, *, seconds: int, top: int = 5, days: int = 7) -> dict:
    """Every worker's first page: state, helmet, latest readings (the packet's other columns), their own newest alerts."""
    at = F.lit(now).cast("timestamp_ntz")
    seen = T.last_seen(packets, "worker").select(F.col("worker").alias("_s"), "seen")
    worn = helmets.where("wearer is not null").groupBy("wearer").agg(F.min("helmet").alias("helmet"))
    helmet = workers.join(worn, F.col("worker_id") == F.col("wearer")).join(seen, F.col("worker_id") == F.col("_s"), "left")
    helmet = helmet.select("worker_id", "helmet", online(F.col("seen").cast("timestamp"), at.cast("timestamp"), seconds).alias("online"), "seen")
    latest = T.latest_packet(packets.drop("gps"), "worker").drop("event_id")
    latest = latest.join(workers.select("worker_id"), F.col("worker") == F.col("worker_id"), "left_semi")
    ours = C.within(F.col("ts"), at - F.expr(f"interval '{days}' day"), at)
    recent = alerts.where(ours).join(workers.select("worker_id"), F.col("worker") == F.col("worker_id"), "left_semi")
    recent = newest(recent, ["worker"], top)
    return {"status": (standing(workers, states, emergencies), ["worker_id"]), "helmet": (helmet, ["worker_id"]), "sensors": (latest, ["worker"]), "alerts": (recent.select("worker", "place", "event_id", "kind", "ts"), ["worker", "place"])}


def prediction_histories(workers: DataFrame, predictions: DataFrame, states: DataFrame, emergencies: DataFrame, day: str, *, gap_seconds: int) -> dict:
    """Every worker's prediction history: status, latest accepted vote, and the segments of a local day.

    predictions: worker, us, ts, event_id, accepted, smoothed, state, confidence, quality, reason. Accepted votes with a
    smoothed state and UNCERTAIN rows (without confidence) make the segments, so nothing is stretched over doubt.
    """
    voted = F.col("accepted") & F.col("smoothed").isNotNull()
    doubt = F.coalesce(F.col("state") == "UNCERTAIN", F.lit(False))
    known = predictions.join(workers.select("worker_id"), F.col("worker") == F.col("worker_id"), "left_semi")
    accepted = known.where(F.coalesce(voted, F.lit(False)) & ~doubt).select("worker", "ts", "event_id", F.col("smoothed").alias("state"), "confidence")
    rows = P.in_period(known, "daily", day).where(F.coalesce(voted, F.lit(False)) | doubt)
    rows = rows.withColumns({"state": F.when(doubt, "UNCERTAIN").otherwise(F.col("smoothed")), "confidence": F.when(~doubt, F.col("confidence"))})
    segments = L.compressed(rows.select("worker", "us", "event_id", "state", "reason", "confidence", "quality"), gap_seconds)
    return {"status": (standing(workers, states, emergencies), ["worker_id"]), "latest": (T.latest_packet(accepted, "worker").drop("event_id"), ["worker"]), "today": (segments, ["worker", "segment"])}


def guidance_documents(workers: DataFrame, helmets: DataFrame, packets: DataFrame, profiles: DataFrame, states: DataFrame, emergencies: DataFrame, now: Column, *, seconds: int, attention_percent: float, viewer: str) -> DataFrame:
    """Every worker's guidance: state, risk, title and text, up to four factors, up to five actions, conditions to attend to.

    packets: worker, ts, event_id, the site channels of RANGES, heartRate, bodyTemperature; profiles: worker_id, heart,
    body. NO_HELMET without a helmet, and NO_DATA without a packet, have neither factors nor actions; an emergency comes
    before NO_DATA. While data are uncertain only a raised risk counts.
    """
    last = T.latest_packet(packets, "worker").withColumnRenamed("worker", "_w")
    worn = helmets.where("wearer is not null").select(F.col("wearer").alias("_h")).distinct()
    on = emergencies.select(F.col("worker").alias("_e")).distinct()
    base = profiles.select(F.col("worker_id").alias("_b"), "heart", "body")
    joined = workers.select("worker_id").join(worn, F.col("worker_id") == F.col("_h"), "left").join(last, F.col("worker_id") == F.col("_w"), "left").join(base, F.col("worker_id") == F.col("_b"), "left")
    joined = joined.join(on, F.col("worker_id") == F.col("_e"), "left").join(states.withColumnRenamed("worker", "_s"), F.col("worker_id") == F.col("_s"), "left")
    urgent, doubt, role = F.col("_e").isNotNull(), F.coalesce("uncertain", F.lit(False)), F.lit(viewer)
    risk = F.when(~doubt | F.col("state").isin("WARNING", "CRITICAL"), F.col("state"))
    live = F.col("_h").isNotNull() & F.col("_w").isNotNull()
    heard = F.when(live, online(F.col("ts").cast("timestamp"), now.cast("timestamp"), seconds))
    found = N.factors({c: F.col(c) for c in N.RANGES}, (F.col("heartRate"), F.col("heart")), (F.col("bodyTemperature"), F.col("body")), heard, attention_percent)
    rows = joined.select("worker_id", risk.alias("risk"), urgent.alias("_urgent"), doubt.alias("_doubt"), heard.alias("online"), "ts", found.alias("found"), F.col("_h").isNotNull().alias("_worn"), live.alias("_live"), reason_text(F.col("reason")).alias("_why"), *N.RANGES)
    levels = {c: N.channel_level(c, F.col(c)) for c in N.RANGES}
    needs = F.exists("found", lambda f: (f["factor"] == "heartRate") & f["attention"])
    state = overall_state(F.col("_urgent"), F.col("risk"), F.transform("found", lambda f: f["severity"]), F.col("_doubt"))
    state = F.when(~F.col("_worn"), "NO_HELMET").when(~F.col("_live"), F.when(F.col("_urgent"), "EMERGENCY").otherwise("NO_DATA")).otherwise(state)
    todo = G.actions(levels, needs, F.col("online"), F.col("risk"), F.col("_doubt"), F.col("_urgent"), role)
    none = F.array().cast("array<string>")
    rows = rows.select(
        "*", state.alias("state"), F.when(F.col("_live"), N.attention_count(F.col("found"))).otherwise(0).alias("attention"), F.when(F.col("_live"), todo).otherwise(none).alias("actions"),
        F.when(F.col("_live"), F.slice("found", 1, N.MOST_FACTORS)).otherwise(F.slice("found", 1, 0)).alias("factors"),
    )
    return rows.select(
        "worker_id", "state", F.when(F.col("_worn"), F.col("risk")).alias("risk"), (F.col("_worn") & F.col("_urgent")).alias("emergency"), "online", F.when(F.col("_live"), F.col("ts")).alias("updated"),
        F.when(F.col("_live"), F.when(F.col("online"), "now").otherwise("last known")).alias("readings"),
        G.summary_title(F.col("state")).alias("title"), G.summary_text(F.col("state"), F.col("attention"), F.col("_why"), role).alias("text"), "factors", "actions", "attention",
    )


def _alert_trend(alerts: DataFrame, kind: str, date: str) -> DataFrame:
    """Warnings and criticals in each bucket of a period, zero in empty ones; the spine has at most 31 rows."""
    spine = alerts.sparkSession.range(1).select(F.explode(C.buckets(F.lit(kind), F.lit(date).cast("date"))).alias("bucket"))
    counts = alerts.groupBy(C.bucket_of(F.lit(kind), F.col("ts")).alias("bucket")).agg(F.count_if(F.col("kind") == "WARNING").alias("warnings"), F.count_if(F.col("kind") == "CRITICAL").alias("criticals"))
    return F.broadcast(spine).join(counts, "bucket", "left").na.fill(0, ["warnings", "criticals"])


def _channels(rows: DataFrame) -> DataFrame:
    """Of each channel that has values: mean, extremes, warnings and criticals by RANGES, and the local days with a critical."""
    day = site_time(F.col("ts")).cast("date").alias("day")
    long = rows.select(day, *[N.finite(F.col(c)).alias(c) for c in N.RANGES]).unpivot(["day"], list(N.RANGES), "channel", "value").where("value is not null")
    level = F.lit(None).cast("string")
    for c in N.RANGES:
        level = F.when(F.col("channel") == c, N.channel_level(c, F.col("value"))).otherwise(level)
    by_day = long.withColumn("level", level).groupBy("channel", "day").agg(
        F.sum("value").alias("s"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.count_if(F.col("level") == "WARNING").alias("w"), F.count_if(F.col("level") == "CRITICAL").alias("c")
    )
    return by_day.groupBy("channel").agg(
        half_up(F.sum("s") / F.sum("n"), 1).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("w").alias("warnings"), F.sum("c").alias("criticals"), F.count_if(F.col("c") > 0).alias("critical_days")
    )


def _compared(alerts: DataFrame, packets: DataFrame, start: Column) -> DataFrame:
    """Alerts, workers and channel means before and from start on, with the change in percent.

    The later channel means have one digit, the earlier ones are as they are.
    """
    now = F.col("ts") >= start
    kinds = {"total": ["WARNING", "CRITICAL", "EMERGENCY"], "warning": ["WARNING"], "critical": ["CRITICAL"], "emergency": ["EMERGENCY"]}
    of = lambda ks, when: F.count_if(when & F.col("kind").isin(*ks)).cast("double")
    counts = alerts.agg(*[x for m, ks in kinds.items() for x in (of(ks, now).alias(f"{m}_now"), of(ks, ~now).alias(f"{m}_before"))])
    heads = alerts.select("worker", now.alias("now")).union(packets.select("worker", now.alias("now"))).distinct()
    heads = heads.agg(F.count(F.when(F.col("now"), F.col("worker"))).cast("double").alias("workers_now"), F.count(F.when(~F.col("now"), F.col("worker"))).cast("double").alias("workers_before"))
    means = packets.agg(*[x for c in N.RANGES for x in (half_up(F.avg(F.when(now, N.finite(F.col(c)))), 1).alias(f"{c}_now"), F.round(F.avg(F.when(~now, N.finite(F.col(c)))), 6).alias(f"{c}_before"))])
    one = counts.crossJoin(heads).crossJoin(means)  # one row each
    rows = [F.struct(F.lit(m).alias("measure"), F.col(f"{m}_now").alias("now"), F.col(f"{m}_before").alias("before")) for m in [*kinds, "workers", *N.RANGES]]
    return one.select(F.inline(F.array(*rows))).withColumn("change", percent_change(F.col("now"), F.col("before")))


def period_summary(kind: str, date: str, now: Column, *, workers: DataFrame, helmets: DataFrame, packets: DataFrame, alerts: DataFrame, seconds: int, top: int = 10) -> dict:
    """All analytics of one period of the site's calendar, and of the one before for comparison.

    packets: worker, ts, event_id, the channels of RANGES, deviation, counter (a running exposure); alerts: worker, ts,
    event_id, kind, emergency, closed, acknowledged, resolved. Both periods are literals in the filters, so they prune
    the scan. The sentences follow from the other parts.
    """
    b = P.bounds(packets, kind, date)
    start, end = (F.lit(str(b[k])).cast("timestamp_ntz") for k in ("start", "end"))
    both = {name: P._inside(rows, b["previous_start"], b["end"]) for name, rows in (("packets", packets), ("alerts", alerts))}
    seen, raised = (P._inside(rows, b["start"], b["end"]) for rows in (packets, alerts))
    counts, response, trust = A.alert_counts(raised), T.response(raised.where("kind in ('WARNING', 'CRITICAL', 'EMERGENCY')")), T.reliability(helmets, packets, start, end, now, seconds)
    active = P.activity(workers, [raised.select("worker"), seen.select("worker")]).select("workers", F.col("active").alias("with_activity"))
    rate = half_up(F.try_divide(F.col("reporting") * 100.0, F.col("registered")), 1)
    summary = active.crossJoin(counts).crossJoin(response.select("mean_minutes", "unanswered")).crossJoin(trust.select(rate.alias("reporting_rate"), "silent"))  # one row each
    hours, ranked, environment = A.risky_hours(raised, top=5), A.worker_ranking(raised, workers, top=top), _channels(seen)
    ranked = ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("criticals"), F.desc("emergencies"), F.desc("warnings"), F.desc("alerts"), "worker")))  # top rows
    hours = hours.withColumn("place", F.row_number().over(Window.orderBy(F.desc("criticals"), F.desc("warnings"), "bucket")))
    return {
        "summary": (summary.drop("unanswered", "silent"), []), "comparison": (_compared(both["alerts"], both["packets"], start), ["measure"]), "trend": (_alert_trend(raised, kind, date), ["bucket"]),
        "attention": (ranked, ["place"]), "environment": (environment, ["channel"]), "channel_trend": (P.channel_trend(packets, list(N.RANGES), kind, date), ["channel", "bucket"]),
        "health": (A.largest_deviations(seen, top=top), ["worker"]), "exposure": (A.longest_streaks(seen, "counter", top=top), ["worker"]), "helmets": (trust, []),
        "silent": (T.silent(helmets, packets, start, end).withColumn("is_silent", F.lit(True)), ["helmet"]), "response": (response, []), "hours": (hours, ["place"]),
        "insights": (_sentences(kind, hours, ranked, environment, summary), ["place"]),
    }


def _sentences(kind: str, hours: DataFrame, ranked: DataFrame, environment: DataFrame, summary: DataFrame) -> DataFrame:
    """What stands out in a period, in words of our own and in this order: the worst hour, the worker with most criticals,
    silent helmets, channels with critical days (not of a single day), emergencies, unanswered alerts; what is 0 is left out."""
    text = lambda place, *parts: F.struct(F.lit(place).alias("place"), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("sentence"))
    col = F.col
    found = [
        hours.where("place = 1").select(text(1, "Most criticals came in the hour from ", F.lpad(col("bucket").cast("string"), 2, "0"), ":00: ", col("criticals"), ", with ", col("warnings"), " warnings.").alias("t")),
        ranked.where("place = 1").select(text(2, "Highest on the list: ", col("name"), " with ", col("criticals"), " criticals, ", col("emergencies"), " emergencies, ", col("warnings"), " warnings.").alias("t")),
        summary.where("silent > 0").select(text(3, "Helmets that sent nothing: ", col("silent"), ".").alias("t")),
        summary.where("emergency > 0").select(text(8, "Emergencies: ", col("emergency"), ".").alias("t")),
        summary.where("unanswered > 0").select(text(9, "Alerts without an answer: ", col("unanswered"), ".").alias("t")),
    ]
    if kind != "daily":
        found += [environment.where((col("channel") == c) & (col("critical_days") > 0)).select(text(4 + i, f"{c} was critical on ", col("critical_days"), " days.").alias("t")) for i, c in enumerate(N.RANGES)]
    return reduce(DataFrame.unionByName, found).select("t.*")
