"""Live features, scoring and confirmed states over the events, each worker's read as one reading a second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearstream.models import training as M
from wearstream.operators.scans import numbered
from wearstream.plans.registry import query
from wearstream.sources.tables import samples, table
from wearstream.streaming import emergencies as E
from wearstream.streaming import live as L
from wearstream.streaming import quality as Q
from wearstream.streaming import runs as R
from wearstream.streaming import stateful
from wearstream.streaming import updates as U

RULES = Q.Rules(warmup=10.0, least_samples=5, calibration=10.0)
CLEAN = {"baseline_hr": 80.0, "baseline_bt": 36.6, "gas_override": 9.0, "heart_rate": 80.0, "body_temperature": 36.6, "ambient_temperature": 25.0, "uv_index": 2.0, "gas": 9.0}


def _readings(spark, d) -> DataFrame:
    """A worker's events in order as seconds; their values are the noise in dB (beyond the range where loud), the rest is steady."""
    rows = numbered(samples(spark, d), "worker", ["event_id"], "second")
    fixed = [F.lit(v).alias(c) for c, v in CLEAN.items()]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("helmet", "string"), ("hr_contact", "boolean"), ("bt_contact", "boolean"), ("control", "string"))]
    return rows.select("worker", F.col("event_id").alias("seq"), (F.col("second") * 1_000_000).alias("us"), F.lit(1).cast("long").alias("workday"), *fixed, F.col("value").alias("noise"), *none)


#: Values from 20 to 140 are taken; others are held for five seconds. Windows are of rows, as there is one a second.
TAKEN = """r AS (SELECT user_id worker, event_id seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 s, CASE WHEN value BETWEEN 20 AND 140 THEN value END v FROM events),
w AS (SELECT *, coalesce(v, CASE WHEN s - max(CASE WHEN v IS NOT NULL THEN s END) OVER p <= 5 THEN last_value(v IGNORE NULLS) OVER p END) noise,
count(v) OVER m n, avg(v) OVER m mean, 10 * log10(avg(pow(10, v / 10)) OVER t) leq, quantile_cont(v, 0.5) OVER a late, count(v) OVER a na, quantile_cont(v, 0.5) OVER b early, count(v) OVER b nb,
sum(CASE WHEN v >= 80 THEN 100.0 / 60.0 * pow(2.0, (v - 85.0) / 3.0) / 480.0 ELSE 0 END) OVER p dose
FROM r WINDOW p AS (PARTITION BY worker ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), m AS (PARTITION BY worker ORDER BY s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), t AS (PARTITION BY worker ORDER BY s ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
a AS (PARTITION BY worker ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY worker ORDER BY s ROWS BETWEEN 59 PRECEDING AND 40 PRECEDING)),
x AS (SELECT *, s - coalesce(max(CASE WHEN coalesce(leq, 0) < 80 THEN s END) OVER p, -1) warned, s - coalesce(max(CASE WHEN coalesce(leq, 0) < 85 THEN s END) OVER p, -1) critical FROM w WINDOW p AS (PARTITION BY worker ORDER BY s))"""


@query(f"""WITH {TAKEN} SELECT worker, seq, noise IS NOT NULL AND s >= 11 AND n >= 12 ready, round(noise, 6) noise, CASE WHEN n >= 12 THEN round(mean, 9) END noise_rolling_mean_60s,
CASE WHEN na >= 10 AND nb >= 10 THEN round((late - early) / 40 * 60, 6) END noise_trend_60s_db_per_min, round(dose, 6) noise_dose_pct, CAST(warned AS DOUBLE) noise_warning_exposure_sec, CAST(critical AS DOUBLE) noise_critical_exposure_sec FROM x""")
def a09_live_noise(spark, d):
    """The noise channel's five live features, and whether the reading is READY."""
    rows = Q.live_features(_readings(spark, d), RULES, audit=True)
    names = ["noise", "noise_rolling_mean_60s", "noise_trend_60s_db_per_min", "noise_dose_pct", "noise_warning_exposure_sec", "noise_critical_exposure_sec"]
    return rows.select("worker", "seq", (F.col("status") == "READY").alias("ready"), *[F.round(c, 9 if "mean" in c else 6).alias(c) for c in names])


@query(None)
def a09_live_features(spark, d):
    """All 38 features of READY readings. No SQL for all channels at once; tests/test_live.py has the plain definitions."""
    return Q.live_features(_readings(spark, d), RULES)


def _model(spark, d):
    """A model of a third of the workers' readings, labelled by their noise; none if none of them is READY."""
    rows = R.kept(Q.live_features(_readings(spark, d).where("worker % 3 = 0"), RULES).where("status = 'READY'").select("noise", "noise_rolling_mean_60s"))
    if rows.isEmpty():
        return None
    label = F.when(F.col("noise") >= 85, 2).when(F.col("noise") >= 60, 1).otherwise(0)
    return M.fit(rows.withColumn("label", label), "Logistic Regression", ["noise", "noise_rolling_mean_60s"], {"maxIter": 20})


@query(None)
def f13_live_states(spark, d):
    """Readings to confirmed states by a model that is fitted here. No SQL: votes by session and alerts are recursive; tested by hand cases."""
    return L.live_states(_readings(spark, d), _model(spark, d), RULES)


#: Votes of the events as results: errors have a low confidence, and a worker's events are one session.
VOTED = """e AS (SELECT user_id worker, event_id seq, CASE WHEN value >= 60 THEN 2 WHEN value >= 30 THEN 1 ELSE 0 END l, event_type <> 'error' ok FROM events), a AS (SELECT * FROM e WHERE ok),
v AS (SELECT *, count(*) FILTER (l = 0) OVER w c0, count(*) FILTER (l = 1) OVER w c1, count(*) FILTER (l = 2) OVER w c2 FROM a WINDOW w AS (PARTITION BY worker ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN c2 >= c1 AND c2 >= c0 THEN 2 WHEN c1 >= c0 THEN 1 ELSE 0 END sm FROM v)"""


def _decided(spark, d):
    x, level = samples(spark, d), F.col("value")
    said = F.when(level >= 60, "CRITICAL").when(level >= 30, "WARNING").otherwise("SAFE")
    confidence = F.when(F.col("event_type") == "error", 0.5).otherwise(0.9)
    rows = x.select("worker", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(1).cast("long").alias("session"), F.lit("READY").alias("status"), F.array().cast("array<string>").alias("reasons"), said.alias("predicted"), confidence.alias("confidence"))
    return L.states(rows)


@query(f"""WITH {VOTED}, t AS (SELECT *, lag(sm) OVER (PARTITION BY worker ORDER BY seq) b FROM s)
SELECT worker, seq, CASE b WHEN 0 THEN 'SAFE' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' END changed_from, CASE sm WHEN 0 THEN 'SAFE' WHEN 1 THEN 'WARNING' ELSE 'CRITICAL' END changed_to FROM t WHERE sm <> b OR (b IS NULL AND sm > 0)""")
def e13_live_transitions(spark, d):
    """Changes of the confirmed state in one session of each worker."""
    return L.transitions(_decided(spark, d)).where("kind = 'RISK_STATE'").select("worker", "seq", "changed_from", "changed_to")


@query(f"""WITH {VOTED}, p AS (SELECT e.worker, e.seq, CASE WHEN sm IS NULL THEN 'UNCERTAIN' WHEN sm = 0 THEN 'SAFE' WHEN sm = 1 THEN 'WARNING' ELSE 'CRITICAL' END AS state, CASE WHEN sm IS NULL THEN 'LOW_CONFIDENCE' END reason FROM e LEFT JOIN s USING (worker, seq)),
f AS (SELECT 'w' || c_custkey recipient, c_custkey worker FROM customer) SELECT recipient, p.* FROM p JOIN f USING (worker) UNION ALL SELECT r.recipient, p.* FROM p, (SELECT 'boss' recipient UNION ALL SELECT 'deputy') r""")
def a27_points(spark, d):
    """The trend points that each worker and two admins are sent."""
    w = table(spark, d, "customer").select(F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("recipient"), F.lit("worker").alias("role"), F.col("c_custkey").alias("worker"))
    bosses = spark.createDataFrame([("boss", "admin", None), ("deputy", "admin", None)], "recipient string, role string, worker long")
    return U.addressed(U.points(_decided(spark, d)), w.unionByName(bosses)).select("recipient", "worker", "seq", "state", "reason")


@query(f"""WITH {VOTED}, z AS (SELECT worker, max(seq) seq, count(*) points FROM e GROUP BY 1), y AS (SELECT worker, arg_max(sm, seq) c FROM s GROUP BY 1)
SELECT z.worker, z.seq, CASE c WHEN 0 THEN 'SAFE' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' END confirmed, points FROM z LEFT JOIN y USING (worker)""")
def f19_snapshots(spark, d):
    return U.snapshots(_decided(spark, d)).select("worker", "seq", "confirmed", "points")


#: The phase (0 inactive, 1 active, 2 reset requested) before and after each action, by a fold over the actions up to it.
COURSE = """x AS (SELECT user_id worker, event_id seq, epoch_us(ts) us, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 0 END k FROM events),
y AS (SELECT *, list(k) OVER (PARTITION BY worker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ks FROM x),
f AS (SELECT *, list_reduce([0] || ks, lambda s, k: CASE WHEN k = 1 THEN greatest(s, 1) WHEN k = 2 AND s = 1 THEN 2 WHEN k = 3 AND s = 2 THEN 0 ELSE s END) p FROM y),
c AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY worker ORDER BY seq), 0) b FROM f)"""
OUTCOME = "CASE k WHEN 1 THEN CASE WHEN b = 0 THEN 'activated' ELSE 'refreshed' END WHEN 2 THEN CASE b WHEN 0 THEN '{refused}' WHEN 1 THEN 'requested' ELSE 'repeated' END WHEN 3 THEN CASE WHEN b = 2 THEN 'resolved' ELSE 'stale' END ELSE '{other}' END"
PHASE = "CASE p WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' ELSE 'reset_requested' END"


def _action():
    kind = F.col("event_type")
    return F.when(kind == "error", "press").when(kind == "purchase", "request").when(kind == "click", "ack").when(kind == "view", "poll")


def _course(spark, d):
    e = samples(spark, d)
    return E.emergencies(e.select("worker", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit("H").alias("helmet"), _action().alias("action"), (F.col("value") / 10).alias("lat"), (F.col("value") / 20).alias("lon")))


@query(f"WITH {COURSE} SELECT worker, seq, us, {PHASE} phase, {OUTCOME.format(refused='refused', other='ignored')} outcome FROM c")
def f15_emergencies(spark, d):
    e = samples(spark, d)
    return stateful.emergencies(e.select("worker", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("event_type") != "view", _action()).alias("action")))


@query(f"""WITH {COURSE}, o AS (SELECT c.*, event_type, {OUTCOME.format(refused='NO_ACTIVE_EMERGENCY', other='ignored')} o FROM c JOIN events ON event_id = seq)
SELECT worker, seq, {PHASE} phase, CASE WHEN event_type = 'view' THEN 'answered' ELSE o END outcome, CASE WHEN event_type = 'view' THEN p = 2 END AS reset FROM o""")
def f15_course(spark, d):
    """Presses, requests, polls and acknowledgements of each worker as one course."""
    return _course(spark, d).select("worker", "seq", "phase", "outcome", "reset")


@query(f"""WITH {COURSE}, n AS (SELECT c.*, value, CAST(sum(CAST(k = 1 AND b = 0 AS INT)) OVER (PARTITION BY worker ORDER BY seq) AS BIGINT) episode, p > 0 OR (k = 3 AND b = 2) inside FROM c JOIN events ON event_id = seq)
SELECT worker, episode, min(us) FILTER (k = 1 AND b = 0) started_us, max(us) FILTER (k = 3 AND b = 2) resolved_us, count(*) FILTER (k = 1) presses, arg_max(value / 10, seq) FILTER (k = 1) lat FROM n WHERE inside GROUP BY 1, 2""")
def a08_alerts(spark, d):
    """Each emergency with its beginning, end, presses and last place."""
    return E.alerts(_course(spark, d)).select("worker", "episode", "started_us", "resolved_us", "presses", "lat")


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'NO_HELMET' END, CASE WHEN event_id % 7 = 0 THEN 'NO_TIME' WHEN event_id % 11 = 0 THEN 'BAD_TIME' END, CASE WHEN event_type <> 'error' THEN 'NO_EMERGENCY' END, CASE WHEN value > 90 THEN 'BAD_LAT' END, CASE WHEN value > 180 THEN 'BAD_LON' END) problems,
CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0 AND event_type = 'error' AND value <= 90 THEN epoch_us(date_trunc('second', ts)) END us FROM events""")
def a08_packets(spark, d):
    """The events as emergency packets in JSON, checked."""
    k, v = F.col("event_id"), F.col("value")
    time = F.when(k % 7 == 0, "").when(k % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = F.struct(F.when(k % 5 > 0, "H").alias("helmetId"), time.alias("timestamp"), (F.col("event_type") == "error").alias("emergency"), F.struct(v.alias("lat"), v.alias("lon")).alias("gps"))
    rows = E.packets(samples(spark, d).select("event_id", F.to_json(body).alias("value")))
    return rows.select("event_id", F.concat_ws(",", "problems").alias("problems"), "us")
