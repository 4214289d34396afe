"""Emergencies from packet to resolution: validated presses, reset requests, polls and acknowledgements in one ordered state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearstream.functions.calendar import instant
from wearstream.streaming.keyed import Fold, fold

ACTIONS = ("press", "request", "poll", "ack")
COLUMNS = ["seq", "us", "helmet", "action", "lat", "lon"]
OUT = (
    "worker long, seq long, us long, helmet string, action string, phase string, outcome string, reset boolean, episode long, started_us long, lat double, lon double"
)


def _kind(v: Column, path: str) -> Column:
    """The kind of a JSON value; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def packets(rows: DataFrame, text: str = "value") -> DataFrame:
    """Emergency packets as JSON text: the rows' columns, helmet, worker, us, lat, lon, and problems, which is empty for a valid one.

    Problems are NOT_AN_OBJECT (then alone), NO_HELMET (missing, empty or no text), NO_TIME (missing, empty, 0 or false), BAD_TIME (neither
    an ISO time nor milliseconds), NO_EMERGENCY (neither emergency: true nor status.overall EMERGENCY), BAD_GPS (no
    object), BAD_LAT and BAD_LON (no number in range). A null gps is none. Values are null where a packet isn't valid.
    """
    # each step's columns are read often by the next, so they are columns of their own: parsed and found once for a row
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    paths = {p: f"_kind{i}" for i, p in enumerate(("$", "$.helmetId", "$.timestamp", "$.emergency", "$.gps", "$.gps.lat", "$.gps.lon"))}
    read = {
        "_said": get("$.timestamp", "string"), "_stamp": get("$.timestamp", "double"), "_helmet": get("$.helmetId", "string"), "_worker": get("$.workerId", "string"),
        "_urgent": get("$.emergency", "string"), "_overall": get("$.status.overall", "string"), "_lat": get("$.gps.lat", "double"), "_lon": get("$.gps.lon", "double"),
    }
    found_in = rows.withColumn("_v", F.try_parse_json(text)).withColumns({c: F.coalesce(_kind(F.col("_v"), p), F.lit("VOID")) for p, c in paths.items()} | read)
    kind = {p: F.col(c) for p, c in paths.items()}
    number = lambda p: kind[p].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    said = F.col("_said")
    from_text = F.unix_micros(instant(said))
    time = F.when(number("$.timestamp"), (F.col("_stamp") * 1000).cast("long")).when(kind["$.timestamp"] == "STRING", from_text)
    missing = (kind["$.timestamp"] == "VOID") | said.isin("", "false") | (number("$.timestamp") & (F.col("_stamp") == 0))
    urgent = ((kind["$.emergency"] == "BOOLEAN") & (F.col("_urgent") == "true")) | F.coalesce(F.col("_overall") == "EMERGENCY", F.lit(False))
    placed, there = kind["$.gps"] != "VOID", kind["$.gps"].startswith("OBJECT")
    inside = lambda c, most: number(f"$.gps.{c}") & F.coalesce(F.col(f"_{c}").between(-most, most), F.lit(False))
    found = [
        F.when((kind["$.helmetId"] != "STRING") | (F.col("_helmet") == ""), "NO_HELMET"), F.when(missing, "NO_TIME").when(time.isNull(), "BAD_TIME"), F.when(~urgent, "NO_EMERGENCY"),
        F.when(placed & ~there, "BAD_GPS"), F.when(there & ~inside("lat", 90), "BAD_LAT"), F.when(there & ~inside("lon", 180), "BAD_LON"),
    ]
    problems = F.when(~kind["$"].startswith("OBJECT"), F.array(F.lit("NOT_AN_OBJECT"))).otherwise(F.array_compact(F.array(*found)))
    checked = found_in.withColumns({"_us": time, "problems": problems})
    valid = lambda c: F.when(F.size("problems") == 0, c)
    return checked.select(
        *rows.columns, valid(F.col("_helmet")).alias("helmet"), valid(F.col("_worker")).alias("worker_given"), valid(F.col("_us")).alias("us"),
        *[valid(F.when(there, F.col(f"_{c}"))).alias(c) for c in ("lat", "lon")], "problems",
    )


def united(**streams: DataFrame) -> DataFrame:
    """The actions (seq, us, helmet; presses with lat and lon) of several streams, given by their action's name, as one."""
    unknown = sorted(set(streams) - set(ACTIONS))
    if unknown or not streams:
        raise ValueError(f"no such actions: {unknown}")
    none = F.lit(None).cast("double")
    rows = [t.select("seq", "us", "helmet", F.lit(a).alias("action"), *[(F.col(c) if c in t.columns else none).alias(c) for c in ("lat", "lon")]) for a, t in streams.items()]
    return reduce(DataFrame.unionByName, rows)


def resolved_workers(actions: DataFrame, wearers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions of helmets with a known wearer (helmet, worker), with the worker; and those of others, refused as WORKER_NOT_FOUND.

    A poll of an unknown helmet is answered with reset false instead.
    """
    named = actions.join(wearers.select(F.col("helmet").alias("_h"), F.col("worker").cast("long").alias("worker")), F.col("helmet") == F.col("_h"), "left").drop("_h")
    poll = F.col("action") == "poll"
    lost = named.where("worker is null").select("seq", "us", "helmet", "action", F.when(poll, "answered").otherwise("WORKER_NOT_FOUND").alias("outcome"), F.when(poll, False).alias("reset"))
    return named.where("worker is not null"), lost


class Course(Fold):
    """One worker's emergencies, one after the other."""

    states = {"course": "phase string, episode long, started long, lat double, lon double"}
    #: By phase and action: the next phase and the outcome. Others leave the phase as it is.
    MOVES = {
        ("inactive", "press"): ("active", "activated"), ("active", "press"): ("active", "refreshed"), ("reset_requested", "press"): ("reset_requested", "refreshed"),
        ("inactive", "request"): ("inactive", "NO_ACTIVE_EMERGENCY"), ("active", "request"): ("reset_requested", "requested"), ("reset_requested", "request"): ("reset_requested", "repeated"),
        ("inactive", "ack"): ("inactive", "stale"), ("active", "ack"): ("active", "stale"), ("reset_requested", "ack"): ("inactive", "resolved"),
    }

    def begin(self, stored: dict) -> dict:
        return stored.get("course") or {"phase": "inactive", "episode": 0, "started": None, "lat": None, "lon": None}

    def end(self, now: dict) -> dict:
        return {"course": now}

    def step(self, now: dict, row: dict) -> tuple:
        answered = "answered" if row["action"] == "poll" else "ignored"
        now["phase"], outcome = self.MOVES.get((now["phase"], row["action"]), (now["phase"], answered))
        if outcome == "activated":
            now |= {"episode": now["episode"] + 1, "started": row["us"], "lat": None, "lon": None}
        if row["action"] == "press" and row["lat"] is not None and row["lon"] is not None:
            now |= {"lat": row["lat"], "lon": row["lon"]}  # also a repeated press tells where the worker is
        on = now["phase"] != "inactive" or outcome == "resolved"
        told = (now["episode"], now["started"], now["lat"], now["lon"]) if on else (None,) * 4
        reset = now["phase"] == "reset_requested" if row["action"] == "poll" else None
        return row["seq"], row["us"], row["helmet"], row["action"], now["phase"], outcome, reset, *told


def emergencies(actions: DataFrame) -> DataFrame:
    """Each action (worker and COLUMNS, in order of seq) with the phase after it, its outcome, and the emergency it belongs to.

    A press activates, or only refreshes an active emergency's location; a request asks for the reset of an active one, is
    repeated without effect, or refused without one; a poll is answered with whether a reset waits; an ack ends a
    requested reset and is otherwise stale. Other or null actions are ignored. Sensor readings play no part.
    """
    return fold(actions, "worker", COLUMNS, OUT, Course())


def alerts(course: DataFrame) -> DataFrame:
    """One row for each emergency of `emergencies`: when it began, where it was last, presses, and when it was resolved (null while open)."""
    rows = course.where("episode is not null")
    return rows.groupBy("worker", "episode").agg(
        F.min("started_us").alias("started_us"), F.max(F.when(F.col("outcome") == "resolved", F.col("us"))).alias("resolved_us"),
        F.count_if(F.col("action") == "press").alias("presses"), F.max_by("lat", "seq").alias("lat"), F.max_by("lon", "seq").alias("lon"), F.min_by("helmet", "seq").alias("helmet"),
    )


#: Who is told of an outcome: roles and the worker.
NOTICES = {"activated": ["admin"], "requested": ["admin", "worker"], "resolved": ["admin", "worker"]}


def notices(course: DataFrame) -> DataFrame:
    """Whom each outcome is told: worker, seq, us, outcome, audience (admin or worker)."""
    to = F.create_map(*[x for k, v in NOTICES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    return course.select("worker", "seq", "us", "outcome", F.explode(F.element_at(to, F.col("outcome"))).alias("audience"))
