"""Workers, helmets and alerts of a site: side inputs, assignments, locations, response and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearstream.functions.scalars import half_up
from wearstream.operators.quantiles import quantiles


def with_baseline(readings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Readings (worker, ...) with their worker's baselines (worker_id, heart, body), found, and has_baseline: both above 0."""
    known = profiles.select("worker_id", "heart", "body", F.lit(True).alias("_found"))
    has = F.coalesce((F.col("heart") > 0) & (F.col("body") > 0), F.lit(False))
    return readings.join(known, readings.worker == known.worker_id, "left").withColumn("found", F.coalesce("_found", F.lit(False))).withColumn("has_baseline", has).drop("worker_id", "_found")


def resolved(packets: DataFrame, workers: DataFrame) -> DataFrame:
    """Packets (id, helmet, supplied) with the worker they belong to and the outcome.

    A supplied worker must exist (else WORKER_NOT_FOUND, kept under the supplied id) and not wear another helmet (else
    WORKER_HELMET_MISMATCH); without one the helmet's worker counts (else NO_WORKER_ASSIGNED). workers: worker_id, helmet.
    """
    named = workers.select(F.col("worker_id").alias("_named"), F.col("helmet").alias("_worn"))
    wearer = workers.where("helmet is not null").groupBy(F.col("helmet").alias("_helmet")).agg(F.min("worker_id").alias("_wearer"))
    joined = packets.join(named, F.col("supplied") == F.col("_named"), "left").join(wearer, F.col("helmet") == F.col("_helmet"), "left")
    given = F.col("supplied").isNotNull()
    mismatch = F.col("_worn").isNotNull() & (F.col("_worn") != F.col("helmet"))
    outcome = F.when(given & F.col("_named").isNull(), "WORKER_NOT_FOUND").when(given & mismatch, "WORKER_HELMET_MISMATCH").when(~given & F.col("_wearer").isNull(), "NO_WORKER_ASSIGNED").otherwise("OK")
    worker = F.when(given & ~(F.col("_named").isNotNull() & mismatch), F.col("supplied")).when(~given, F.col("_wearer"))
    return joined.select("id", worker.alias("worker"), outcome.alias("outcome"))


def shaped_alerts(alerts: DataFrame, workers: DataFrame, emergencies: DataFrame) -> DataFrame:
    """Alerts with their worker's name and, for emergencies only, the worker's unresolved phase."""
    open_ones = emergencies.where("phase <> 'inactive'").select(F.col("worker").alias("_w"), "phase")
    joined = alerts.join(workers, alerts.worker == workers.worker_id, "left").join(open_ones, (alerts.worker == F.col("_w")) & (alerts.kind == "EMERGENCY"), "left")
    return joined.select("event_id", "kind", F.coalesce("name", alerts.worker.cast("string")).alias("name"), "phase")


def last_position(packets: DataFrame, key: str) -> DataFrame:
    """Each key's last valid position; keys without any are left out."""
    return packets.where("gps is not null").groupBy(key).agg(F.max_by("gps", F.struct("ts", "event_id")).alias("gps"))


def last_seen(packets: DataFrame, key: str) -> DataFrame:
    return packets.groupBy(key).agg(F.max("ts").alias("seen"))


def latest_packet(packets: DataFrame, key: str) -> DataFrame:
    """Each key's latest packet as a whole."""
    rest = [c for c in packets.columns if c != key]
    return packets.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("row")).select(key, "row.*")


def locations(workers: DataFrame, helmets: DataFrame, packets: DataFrame, states: DataFrame) -> DataFrame:
    """Workers who wear an active helmet and have a position: with it, when they were last seen, and their state."""
    wearing = workers.join(helmets.where("active and wearer is not null"), F.col("worker_id") == F.col("wearer"), "left_semi")
    placed = wearing.join(last_position(packets, "worker"), F.col("worker_id") == F.col("worker")).drop("worker")
    return placed.join(last_seen(packets, "worker"), F.col("worker_id") == F.col("worker"), "left").drop("worker").join(states, F.col("worker_id") == F.col("worker"), "left").select(
        "worker_id", F.col("gps.lat").alias("lat"), F.col("gps.lon").alias("lon"), "seen", F.coalesce("state", F.lit("UNKNOWN")).alias("state")
    )


def assignments(helmets: DataFrame, workers: DataFrame) -> DataFrame:
    """Each helmet's standing: assigned to a known worker, assignable (active, free), or unassigned."""
    known = workers.select(F.col("worker_id").alias("_w"))
    standing = F.when(F.col("_w").isNotNull(), "assigned").when(F.col("active"), "assignable").otherwise("unassigned")
    return helmets.join(known, F.col("wearer") == F.col("_w"), "left").select("helmet", standing.alias("standing"))


def removable(helmets: DataFrame, workers: DataFrame) -> DataFrame:
    """Helmets with removed set where nobody wears them; the others stay as they are."""
    worn = workers.select(F.col("worker_id").alias("_w"))
    free = helmets.join(worn, F.col("wearer") == F.col("_w"), "left_anti").withColumn("removed", F.lit(True))
    return free.unionByName(helmets.join(worn, F.col("wearer") == F.col("_w"), "left_semi").withColumn("removed", F.lit(False)))


def helmet_summary(helmets: DataFrame, seen: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Registered, online, offline and assigned helmets, and the share online in percent with one digit; never seen counts as offline."""
    joined = helmets.join(seen.select(F.col("worker").alias("_w"), "seen"), F.col("wearer") == F.col("_w"), "left")
    on = F.coalesce(F.col("seen") >= now - F.expr(f"interval '{seconds}' second"), F.lit(False))
    one = joined.agg(F.count("*").alias("registered"), F.count_if(on).alias("online"), F.count_if(~on).alias("offline"), F.count("wearer").alias("assigned"))
    return one.withColumn("online_percent", half_up(F.coalesce(F.try_divide(F.col("online") * 100.0, F.col("registered")), F.lit(0.0)), 1))


def unread(notifications: DataFrame, read: Column) -> DataFrame:
    return notifications.groupBy("recipient").agg(F.count("*").alias("total"), F.count_if(~read).alias("unread"))


def coverage(helmets: DataFrame, packets: DataFrame, start: Column, end: Column, now: Column, seconds: int = 1) -> DataFrame:
    """Of each helmet (helmet, wearer, registered, removed: times or null) the packets in [start, end), those expected, and the share.

    The window begins at the helmet's registration at the earliest, and ends now or at its removal at the latest. One packet
    is expected each so many seconds; the share is in whole percents, at most 100, null where none is expected.
    """
    counts = packets.where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy("worker").agg(F.count("*").alias("n"))
    from_, to = F.greatest(start, F.col("registered")), F.least(end, now, F.col("removed"))
    micros = F.unix_micros(to.cast("timestamp")) - F.unix_micros(from_.cast("timestamp"))
    joined = helmets.join(counts, helmets.wearer == counts.worker, "left").withColumn("packets", F.coalesce("n", F.lit(0)))
    joined = joined.withColumn("expected", F.greatest(F.lit(0), F.floor(micros / (1_000_000 * seconds))).cast("long"))
    share = F.least(F.lit(100.0), half_up(F.try_divide(F.col("packets") * 100.0, F.col("expected")), 0))
    return joined.select("helmet", "packets", "expected", F.when(F.col("expected") > 0, share).alias("coverage"))


def reliability(helmets: DataFrame, packets: DataFrame, start: Column, end: Column, now: Column, online_seconds: int) -> DataFrame:
    """Of active helmets: how many, how many reported in [start, end), which didn't (in order), and how many are online now."""
    reported = packets.where((F.col("ts") >= start) & (F.col("ts") < end)).select(F.col("worker").alias("_r")).distinct()
    seen = last_seen(packets, "worker").select(F.col("worker").alias("_w"), "seen")
    joined = helmets.where("active").join(reported, F.col("wearer") == F.col("_r"), "left").join(seen, F.col("wearer") == F.col("_w"), "left")
    on = F.coalesce(F.col("seen") >= now - F.expr(f"interval '{online_seconds}' second"), F.lit(False))
    return joined.agg(
        F.count("*").alias("registered"), F.count("_r").alias("reporting"), F.count_if(F.col("_r").isNull()).alias("silent"), F.count_if(on).alias("online"), F.count_if(~on).alias("offline")
    )


def silent(helmets: DataFrame, packets: DataFrame, start: Column, end: Column) -> DataFrame:
    """Active helmets without a packet in [start, end)."""
    reported = packets.where((F.col("ts") >= start) & (F.col("ts") < end)).select(F.col("worker").alias("_r")).distinct()
    return helmets.where("active").join(reported, F.col("wearer") == F.col("_r"), "left_anti").select("helmet")


def response(alerts: DataFrame) -> DataFrame:
    """Alerts (emergency: boolean; acknowledged, resolved: minutes or null; closed: boolean): totals, answers and resolutions.

    The share acknowledged in percent; mean and median minutes to it; emergencies closed and open; mean minutes to the
    resolution of those emergencies that have one, and their number. One digit throughout; null where nothing counts.
    """
    urgent = F.col("emergency")
    done = F.when(urgent, F.col("resolved"))
    digits = lambda c: half_up(c, 1)
    one = alerts.agg(
        F.count("*").alias("total"), F.count("acknowledged").alias("answered"), F.count_if(F.col("acknowledged").isNull()).alias("unanswered"),
        digits(F.try_divide(F.count("acknowledged") * 100.0, F.count("*"))).alias("answer_rate"), digits(F.avg("acknowledged")).alias("mean_minutes"),
        F.count_if(urgent & F.col("closed")).alias("closed_emergencies"), F.count_if(urgent & ~F.col("closed")).alias("open_emergencies"),
        digits(F.avg(done)).alias("mean_resolution"), F.count(done).alias("resolutions"),
    )
    middle = quantiles(alerts, [], "acknowledged", [0.5]).select(digits(F.col("q")[0]).alias("median_minutes"))
    return one.join(middle, F.lit(True), "left")  # one row each


def compared(now: DataFrame, before: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Results that both tables have, with each measure's value and its change."""
    old = before.select(*keys, *[F.col(m).alias(f"{m}_before") for m in measures])
    return now.join(old, keys).select(*keys, *measures, *[F.round(F.col(m) - F.col(f"{m}_before"), 6).alias(f"{m}_change") for m in measures])


def summarised(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """All rows with their key's summary, null where there is none."""
    return rows.join(summary, key, "left")


def aligned(left: DataFrame, right: DataFrame, place: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Two tables row by row at equal places: rows, whether both have as many, and for each column whether all values agree.

    Values agree within the tolerance or if both are null.
    """
    a, b = (t.select(F.col(place).alias("_place"), F.lit(1).alias(f"_{s}"), *[F.col(c).cast("double").alias(f"{s}_{c}") for c in columns]) for t, s in ((left, "a"), (right, "b")))
    both = a.join(b, "_place", "full")
    agree = lambda c: F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
    return both.agg(F.count("*").alias("n"), (F.count("_a") == F.count("_b")).alias("same_length"), *[F.bool_and(agree(c)).alias(c) for c in columns])
