"""Composite views: dashboards, sensor histories, snapshots of workers and helmets, decisions on batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearstream.functions.guidance import actions
from wearstream.functions.results import overall_state
from wearstream.functions.scalars import classified, deviation_percent, half_up, online, operational_state, site_time
from wearstream.operators.sites import last_position, last_seen, latest_packet


def measures(tables: dict[str, DataFrame]) -> DataFrame:
    """One table (part, name, value) of several small ones, each with one row of counts or with (name, value)."""

    def long(part: str, t: DataFrame) -> DataFrame:
        if t.columns == ["name", "value"]:
            rows = t.select("name", F.col("value").cast("double").alias("value"))
        else:
            rows = t.select(*[F.col(c).cast("double").alias(c) for c in t.columns]).unpivot([], t.columns, "name", "value")
        return rows.select(F.lit(part).alias("part"), "name", "value")

    return reduce(DataFrame.unionByName, [long(p, t) for p, t in tables.items()])


def status(workers: DataFrame, packets: DataFrame, states: DataFrame, emergencies: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Every worker's operational state, whether they are online, when they were seen, and their latest value.

    states: worker, state, uncertain; emergencies: worker. A worker without state is UNKNOWN.
    """
    last = latest_packet(packets.select("worker", "ts", "event_id", "value"), "worker").select("worker", F.col("ts").alias("seen"), "value")
    on = emergencies.select("worker", F.lit(True).alias("_emergency")).distinct()
    joined = workers
    for side in (last, states, on):
        joined = joined.join(side.withColumnRenamed("worker", "_w"), F.col("worker_id") == F.col("_w"), "left").drop("_w")
    state = operational_state(F.coalesce("_emergency", F.lit(False)), F.col("state"), F.coalesce("uncertain", F.lit(False)))
    seen = F.col("seen").cast("timestamp")
    return joined.select("worker_id", state.alias("state"), online(seen, now.cast("timestamp"), seconds).alias("online"), "seen", "value")


def sensor_history(packets: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each worker's latest value with the baseline and the deviation in percent to two digits; and daily means with their number."""
    last = latest_packet(packets.select("worker", "ts", "event_id", "value"), "worker")
    joined = last.join(profiles.select(F.col("worker_id").alias("_w"), F.col("heart").alias("baseline")), F.col("worker") == F.col("_w"), "left")
    latest = joined.select("worker", "value", "baseline", half_up(deviation_percent(F.col("value"), F.col("baseline")), 2).alias("deviation_percent"))
    daily = packets.groupBy("worker", site_time(F.col("ts")).cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))
    return latest, daily


def environment_latest(packets: DataFrame, warning: float, critical: float) -> DataFrame:
    """Each worker's latest value with its category and the range that it is in."""
    last = latest_packet(packets.select("worker", "ts", "event_id", "value"), "worker")
    level = classified(F.col("value"), warning, critical)
    low = F.when(level == "CRITICAL", float(critical)).when(level == "WARNING", float(warning))
    return last.select("worker", "value", level.alias("category"), low.alias("from_value"))


def helmet_details(helmets: DataFrame, workers: DataFrame, packets: DataFrame, commands: DataFrame) -> DataFrame:
    """Each helmet with its wearer's name, when it was last seen, where, and its current command."""
    joined = helmets.join(workers.select(F.col("worker_id").alias("_w"), "name"), F.col("wearer") == F.col("_w"), "left").drop("_w")
    for side in (last_seen(packets, "worker"), last_position(packets, "worker"), commands):
        joined = joined.join(side.withColumnRenamed("worker", "_w"), F.col("wearer") == F.col("_w"), "left").drop("_w")
    return joined.select("helmet", "wearer", "name", "seen", F.col("gps.lat").alias("lat"), "command")


def marked_read(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """Notifications (event_id, recipient) with read: set only by the recipient's own read."""
    own = reads.select("event_id", "recipient").distinct().withColumn("read", F.lit(True))
    return notifications.join(own, ["event_id", "recipient"], "left").withColumn("read", F.coalesce("read", F.lit(False)))


def alert_documents(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Alerts of state changes with the readings that triggered them."""
    return changes.join(snapshots.select("event_id", F.struct("value", "ts").alias("snapshot")), "event_id").select("event_id", "worker", "state", "snapshot.value", "snapshot.ts")


def decided(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """Samples (batch, place) with the model's answer for each, or UNCERTAIN for a whole batch that the model failed.

    A batch fails if it has not exactly one answer for each sample, whatever the answers are: it is never SAFE then.
    Answers: batch, place, state; a null state is UNCERTAIN / INVALID_RESULT.
    """
    sent = samples.groupBy("batch").agg(F.count("*").alias("_sent"))
    had = answers.groupBy("batch").agg(F.count("*").alias("_had"), F.count_distinct("place").alias("_places"))
    sound = sent.join(had, "batch", "left").select("batch", F.coalesce((F.col("_sent") == F.col("_had")) & (F.col("_had") == F.col("_places")), F.lit(False)).alias("_sound"))
    joined = samples.join(sound, "batch").join(answers.dropDuplicates(["batch", "place"]), ["batch", "place"], "left")
    ok = F.col("_sound") & F.col("state").isNotNull()
    reason = F.when(~F.col("_sound"), "ML_SERVICE_UNAVAILABLE").when(F.col("state").isNull(), "INVALID_RESULT")
    return joined.withColumn("reason", reason).withColumn("state", F.when(ok, F.col("state")).otherwise("UNCERTAIN")).drop("_sound")


def classified_ready(rows: DataFrame, ready: Column, verdict: Column) -> DataFrame:
    """verdict for READY rows only; the others have none."""
    return rows.withColumn("state", F.when(ready, verdict))


def of_known_workers(rows: DataFrame, workers: DataFrame) -> DataFrame:
    """Rows (worker, state) with reason: those of unknown workers are UNCERTAIN / WORKER_NOT_FOUND whatever their state."""
    joined = rows.join(workers.select(F.col("worker_id").alias("_w")).distinct(), F.col("worker") == F.col("_w"), "left")
    unknown = F.col("_w").isNull()
    return joined.withColumn("reason", F.when(unknown, "WORKER_NOT_FOUND")).withColumn("state", F.when(unknown, "UNCERTAIN").otherwise(F.col("state"))).drop("_w")


def reason_shares(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """Rows of each key, those that are hit, and their share."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("errors")).withColumn("share", F.round(F.col("errors") / F.col("n"), 6))


def guidance_document(rows: DataFrame, baseline: float, limits: tuple[float, float], attention_percent: float) -> DataFrame:
    """Each reading's overall state, actions in order, and how many conditions need attention.

    One channel has limits, and its deviation from a baseline needs attention from attention_percent on.
    """
    level = classified(F.col("value"), *limits)
    far = F.coalesce(F.abs(deviation_percent(F.col("value"), F.lit(baseline))) >= attention_percent, F.lit(False))
    emergency = F.col("event_type") == "error"
    state = overall_state(emergency, level, F.array(level), F.lit(False))
    todo = actions({"noise": level}, far, F.lit(True), level, F.lit(False), emergency)
    count = F.coalesce((level != "SAFE").cast("int"), F.lit(0)) + far.cast("int")
    return rows.select("event_id", state.alias("state"), F.concat_ws(",", todo).alias("actions"), count.alias("attention"))
