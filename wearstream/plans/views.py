"""Guidance, composite views and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wearstream.functions import guidance as G
from wearstream.functions import scalars as S
from wearstream.operators import aggregates as A
from wearstream.operators import joins as J
from wearstream.operators import periods as P
from wearstream.operators import records as O
from wearstream.operators import sites as T
from wearstream.operators import timelines as L
from wearstream.operators import views as V
from wearstream.operators import windows as W
from wearstream.plans.registry import query
from wearstream.plans.sites import HELMETS, PACKETS, _packets
from wearstream.sources import contracts as X
from wearstream.sources.tables import ALERTS_SQL, alerts, helmets, profiles, samples, table, workers
from wearstream.streaming import quality as Q

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
LAST = "z AS (SELECT user_id worker, max(ts) seen, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) kind FROM events GROUP BY 1)"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def _states(spark, d):
    last = T.latest_packet(samples(spark, d).select("worker", "ts", "event_id", "value", "event_type"), "worker")
    return last.select("worker", S.classified(F.col("value"), 30, 60).alias("state"), (F.col("event_type") == "signup").alias("uncertain"))


@query("""WITH x AS (SELECT event_id, event_type = 'error' e, CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' ELSE 'SAFE' END n, CASE event_id % 4 WHEN 0 THEN 'WARNING' ELSE 'SAFE' END g,
  event_id % 3 = 0 att, event_id % 5 > 0 online, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'CRITICAL' ELSE 'SAFE' END risk, event_id % 2 = 0 u FROM events),
a AS (SELECT *, list_filter([CASE WHEN n = 'CRITICAL' THEN {'r': 0, 'p': 1, 'k': 'reduceNoiseExposure'} END, CASE WHEN n = 'WARNING' THEN {'r': 1, 'p': 2, 'k': 'monitorNoiseExposure'} END, CASE WHEN g = 'WARNING' THEN {'r': 1, 'p': 4, 'k': 'monitorGasLevel'} END,
  CASE WHEN att THEN {'r': 1, 'p': 20, 'k': 'checkWorkerCondition'} END, CASE WHEN NOT online THEN {'r': 1, 'p': 21, 'k': 'restoreCommunication'} END], lambda z: z IS NOT NULL) l FROM x),
b AS (SELECT *, list_concat(l, list_filter([CASE WHEN len(l) = 0 AND risk = 'CRITICAL' THEN {'r': 0, 'p': 22, 'k': 'checkWorkerCondition'} END, CASE WHEN u AND risk IS NULL THEN {'r': 1, 'p': 23, 'k': 'checkSensors'} END], lambda z: z IS NOT NULL)) m FROM a)
SELECT event_id, CASE WHEN e AND event_id % 2 = 1 THEN 'locateCheckWorker,followEmergencyProcedure,emergencyResetAfterCheck' WHEN e THEN 'followEmergencyProcedure,seekAssistance,remainSafeLocation' WHEN len(m) = 0 THEN 'continueMonitoring' ELSE array_to_string(list_transform(list_sort(m), lambda z: z.k), ',') END actions FROM b""")
def k02_actions(spark, d):
    k, level = F.col("event_id"), S.classified(F.col("value"), 30, 60)
    risk = F.when(k % 7 == 0, None).when(k % 7 == 1, "CRITICAL").otherwise("SAFE")
    found = G.actions({"noise": level, "gas": F.when(k % 4 == 0, "WARNING").otherwise("SAFE")}, k % 3 == 0, k % 5 > 0, risk, k % 2 == 0, F.col("event_type") == "error", F.when(k % 2 == 1, "ADMIN").otherwise("WORKER"))
    return samples(spark, d).select("event_id", F.concat_ws(",", found).alias("actions"))


@query("""WITH x AS (SELECT n_nationkey k, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_nationkey END a, 12 b, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 24 END h, CASE WHEN n_nationkey % 5 > 0 THEN 80.0 + n_nationkey END c FROM nation)
SELECT k, CASE WHEN a > 0 OR c IS NOT NULL THEN concat_ws('|', CASE WHEN a = b THEN a || ' alerts, as many as before.' ELSE a || ' alerts, ' || abs(a - b) || CASE WHEN a > b THEN ' more' ELSE ' fewer' END || ' than before.' END,
CASE WHEN h IS NOT NULL THEN 'Most critical alerts were at ' || lpad(CAST(h AS VARCHAR), 2, '0') || ':00.' END, CASE WHEN c < 90 THEN 'Only ' || CAST(c AS DECIMAL(5, 1)) || ' % of the expected samples came in.' END) ELSE '' END AS text FROM x""")
def k03_insights(spark, d):
    n = F.col("n_nationkey")
    text = G.insights(F.when(n % 5 == 0, 0).otherwise(n), F.lit(12), F.when(n % 3 > 0, n % 24), F.when(n % 5 > 0, F.lit(80.0) + n))
    return table(spark, d, "nation").select(n.alias("k"), F.concat_ws("|", text).alias("text"))


@query(f"""WITH {ALERTS_SQL}, i AS (SELECT * FROM a WHERE ts >= TIMESTAMP '2024-01-14 18:30:00' AND ts < TIMESTAMP '2024-01-21 18:30:00'), c AS (SELECT count(*) FILTER (kind = 'WARNING') w, count(*) FILTER (kind = 'CRITICAL') c, count(*) FILTER (kind = 'EMERGENCY') e FROM i),
h AS (SELECT lpad(CAST(hour(ts + INTERVAL 330 MINUTE) AS VARCHAR), 2, '0') || ':00' b, count(*) n FROM i WHERE kind = 'CRITICAL' GROUP BY 1)
SELECT 'alerts' part, unnest(['warning', 'critical', 'emergency', 'total']) AS name, CAST(unnest([w, c, e, w + c + e]) AS DOUBLE) AS value FROM c UNION ALL SELECT 'workers', 'active', CAST(count(DISTINCT worker) AS DOUBLE) FROM i UNION ALL SELECT 'hours', b, CAST(n AS DOUBLE) FROM h""")
def k04_summary(spark, d):
    rows = P.in_period(alerts(spark, d), "weekly", "2024-01-17")
    hours = rows.where("kind = 'CRITICAL'").groupBy(F.concat(F.lpad(F.hour(S.site_time(F.col("ts"))).cast("string"), 2, "0"), F.lit(":00")).alias("name")).agg(F.count("*").alias("value"))
    return V.measures({"alerts": A.alert_counts(rows), "workers": rows.agg(F.count_distinct("worker").alias("active")), "hours": hours})


@query(f"""WITH {ALERTS_SQL}, {HELMETS}, l AS (SELECT worker, arg_max(kind, (ts, event_id)) latest FROM a GROUP BY 1) SELECT 'states' part, coalesce(latest, 'UNKNOWN') AS name, CAST(count(*) AS DOUBLE) AS value FROM customer LEFT JOIN l ON worker = c_custkey GROUP BY 2
UNION ALL SELECT 'helmets', unnest(['registered', 'assigned']), CAST(unnest([count(*), count(wearer)]) AS DOUBLE) FROM h UNION ALL SELECT 'alerts', 'today', CAST(count(*) AS DOUBLE) FROM a WHERE ts >= TIMESTAMP '2024-01-29 18:30:00' AND ts < TIMESTAMP '2024-01-30 18:30:00'""")
def l01_dashboard(spark, d):
    latest = alerts(spark, d).groupBy("worker").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("latest"))
    states = J.state_counts(workers(spark, d), latest).select(F.col("state").alias("name"), F.col("workers").alias("value"))
    summary = T.helmet_summary(helmets(spark, d), T.last_seen(samples(spark, d), "worker"), _now(), 3600).select("registered", "assigned")
    return V.measures({"states": states, "helmets": summary, "alerts": P.in_period(alerts(spark, d), "daily", "2024-01-30").agg(F.count("*").alias("today"))})


@query(f"""WITH {LAST}, e AS (SELECT DISTINCT user_id w FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-30 00:00:00')
SELECT c_custkey worker_id, CASE WHEN w IS NOT NULL THEN 'EMERGENCY' WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' WHEN kind = 'signup' THEN 'UNCERTAIN' WHEN value IS NULL THEN 'UNKNOWN' ELSE 'SAFE' END AS state,
CASE WHEN seen IS NOT NULL THEN epoch_us({NOW}) - epoch_us(seen) <= 43200000000 END online, seen, value FROM customer LEFT JOIN z ON z.worker = c_custkey LEFT JOIN e ON w = c_custkey""")
def l02_status(spark, d):
    pressed = samples(spark, d).where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))).select("worker")
    return V.status(workers(spark, d), samples(spark, d), _states(spark, d), pressed, _now(), 12 * 3600)


@query(f"WITH {LAST} SELECT worker, value, c_acctbal baseline, CASE WHEN c_acctbal > 0 THEN floor((value - c_acctbal) / c_acctbal * 100.0 * 100 + 0.5) / 100 END deviation_percent FROM z LEFT JOIN customer ON c_custkey = worker")
def l04_personal_latest(spark, d):
    return V.sensor_history(samples(spark, d), profiles(spark, d))[0]


@query("SELECT user_id worker, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, round(avg(value), 6) mean, count(value) n FROM events GROUP BY 1, 2")
def l04_personal_daily(spark, d):
    return V.sensor_history(samples(spark, d), profiles(spark, d))[1]


@query(f"WITH {LAST} SELECT worker, value, CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' ELSE 'SAFE' END category, CASE WHEN value >= 60 THEN 60.0::DOUBLE WHEN value >= 30 THEN 30.0::DOUBLE END from_value FROM z")
def l05_environment(spark, d):
    return V.environment_latest(samples(spark, d), 30, 60)


@query(f"""WITH s AS (SELECT event_id, user_id worker, epoch_us(ts) us, value, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-19 18:30:00' AND ts < TIMESTAMP '2024-01-20 18:30:00'), t AS (SELECT *, CASE WHEN event_type IN ('error', 'signup') THEN 'UNCERTAIN' WHEN value >= 60 THEN 'CRITICAL' ELSE 'SAFE' END AS state FROM s WHERE event_type <> 'purchase'),
h AS (SELECT *, CASE WHEN coalesce(state = lag(state) OVER w AND us - lag(us) OVER w <= 36000000000 AND (state <> 'UNCERTAIN' OR event_type = lag(event_type) OVER w), false) THEN 0 ELSE 1 END new FROM t WINDOW w AS (PARTITION BY worker ORDER BY us, event_id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY worker ORDER BY us, event_id) AS BIGINT) segment FROM h) SELECT worker, segment, any_value(state) AS state, count(*) n FROM i GROUP BY 1, 2""")
def l06_today(spark, d):
    rows = W.with_micros(P.in_period(samples(spark, d), "daily", "2024-01-20")).where("event_type <> 'purchase'")
    kind, v = F.col("event_type"), F.col("value")
    state = F.when(kind.isin("error", "signup"), "UNCERTAIN").when(v >= 60, "CRITICAL").otherwise("SAFE")
    return L.compressed(rows.withColumns({"state": state, "reason": kind, "quality": F.lit("VALID"), "confidence": v}), 10 * 3600).select("worker", "segment", "state", "n")


@query(f"""WITH {HELMETS}, {PACKETS}, s AS (SELECT worker, max(ts) seen, arg_max(gps, (ts, event_id)) FILTER (gps IS NOT NULL) gps FROM p GROUP BY 1), c AS (SELECT user_id u, arg_max(event_type, (ts, event_id)) command FROM events GROUP BY 1)
SELECT helmet, wearer, c_name AS name, seen, gps.lat lat, command FROM h LEFT JOIN customer ON c_custkey = wearer LEFT JOIN s ON s.worker = wearer LEFT JOIN c ON u = wearer""")
def l07_helmet_details(spark, d):
    commands = O.last_state(samples(spark, d), "worker", ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "command")
    return V.helmet_details(helmets(spark, d), workers(spark, d), _packets(spark, d), commands)


@query(f"""WITH {LAST}, {PACKETS}, g AS (SELECT worker, arg_max(gps, (ts, event_id)).lat lat FROM p WHERE gps IS NOT NULL GROUP BY 1) SELECT c_custkey worker_id, CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' WHEN kind = 'signup' THEN 'UNCERTAIN' WHEN value IS NULL THEN 'UNKNOWN' ELSE 'SAFE' END AS state, seen, value, lat
FROM customer LEFT JOIN z ON z.worker = c_custkey LEFT JOIN g ON g.worker = c_custkey""")
def l08_snapshot(spark, d):
    nobody = workers(spark, d).select(F.col("worker_id").alias("worker")).where("false")
    shown = V.status(workers(spark, d), samples(spark, d), _states(spark, d), nobody, _now(), 180).drop("online")
    place = T.last_position(_packets(spark, d), "worker").select(F.col("worker").alias("_w"), "gps.lat")
    return shown.join(place, F.col("worker_id") == F.col("_w"), "left").drop("_w")


@query("SELECT event_id, user_id % 5 recipient, event_id % 4 = 0 AND user_id % 5 = event_id % 3 AS read FROM events")
def l12_read(spark, d):
    k = F.col("event_id")
    sent = samples(spark, d).select("event_id", (F.col("worker") % 5).alias("recipient"))
    return V.marked_read(sent, samples(spark, d).where(k % 4 == 0).select("event_id", (k % 3).alias("recipient")))


@query("""WITH x AS (SELECT event_id, user_id worker, ts, value, CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' ELSE 'SAFE' END AS state FROM events), y AS (SELECT *, lag(state) OVER (PARTITION BY worker ORDER BY ts, event_id) b FROM x)
SELECT event_id, worker, state, value, ts FROM y WHERE state <> b""")
def l22_alert_documents(spark, d):
    rows = samples(spark, d).withColumn("state", S.classified(F.col("value"), 30, 60))
    changed = rows.withColumn("before", F.lag("state").over(Window.partitionBy("worker").orderBy("ts", "event_id"))).where("state <> before")
    return V.alert_documents(changed.select("event_id", "worker", "state"), samples(spark, d))


@query("""WITH s AS (SELECT user_id batch, event_id place, value FROM events), a AS (SELECT user_id batch, event_id place, CASE WHEN event_id % 10 > 0 THEN event_type END st FROM events WHERE NOT (user_id % 3 = 0 AND event_id % 4 = 0)),
n AS (SELECT batch, count(*) c FROM s GROUP BY 1), m AS (SELECT batch, count(*) c FROM a GROUP BY 1) SELECT s.batch, s.place, CASE WHEN n.c = coalesce(m.c, 0) AND st IS NOT NULL THEN st ELSE 'UNCERTAIN' END AS state,
CASE WHEN n.c <> coalesce(m.c, 0) THEN 'ML_SERVICE_UNAVAILABLE' WHEN st IS NULL THEN 'INVALID_RESULT' END reason FROM s JOIN n USING (batch) LEFT JOIN m USING (batch) LEFT JOIN a ON a.batch = s.batch AND a.place = s.place""")
def f17_decided(spark, d):
    k = F.col("event_id")
    sent = samples(spark, d).select(F.col("worker").alias("batch"), k.alias("place"), "event_type")
    answers = sent.where(~((F.col("batch") % 3 == 0) & (F.col("place") % 4 == 0))).select("batch", "place", F.when(F.col("place") % 10 > 0, F.col("event_type")).alias("state"))
    return V.decided(sent.drop("event_type"), answers)


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' ELSE 'SAFE' END END AS state FROM events")
def f12_ready_only(spark, d):
    return V.classified_ready(samples(spark, d).select("event_id", "value"), F.col("event_id") % 3 > 0, S.classified(F.col("value"), 30, 60)).drop("value")


@query("""WITH r AS (SELECT user_id worker, CAST(ts AS DATE) AS day, event_id, event_type = 'view' stored FROM events), o AS (SELECT DISTINCT worker, day FROM r WHERE stored)
SELECT worker, day, min(event_id) event_id FROM r WHERE NOT stored AND (worker, day) NOT IN (SELECT worker, day FROM o) GROUP BY 1, 2""")
def f18_once(spark, d):
    """Uploads, of which what is stored already comes again and is left out."""
    rows = samples(spark, d).select("worker", F.to_date("ts").alias("day"), "event_id", (F.col("event_type") == "view").alias("stored"))
    return J.unseen(rows.where("not stored").drop("stored"), rows.where("stored").drop("stored"), ["worker", "day"], "event_id")


def _readings(spark, d):
    """Events as readings of helmets that change hands; one channel carries the value, the others are steady."""
    e = table(spark, d, "events")
    clean = {"baseline_hr": 80.0, "baseline_bt": 36.6, "gas_override": 9.0, "body_temperature": 36.6, "ambient_temperature": 25.0, "uv_index": 2.0, "gas": 9.0, "noise": 60.0}
    fixed = [F.lit(v).alias(c) for c, v in clean.items()]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("hr_contact", "boolean"), ("bt_contact", "boolean"), ("control", "string"))]
    return e.select(
        F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.unix_date(S.site_time(F.col("ts")).cast("date")).cast("long").alias("workday"),
        F.concat(F.lit("H"), F.floor(F.col("user_id") / 2).cast("string")).alias("helmet"), F.col("value").alias("heart_rate"), *fixed, *none,
    )


@query("""WITH x AS (SELECT user_id worker, event_id seq, user_id // 2 helmet, lag(user_id) OVER (PARTITION BY user_id // 2 ORDER BY event_id) b FROM events) SELECT b worker, seq FROM x WHERE b <> worker""")
def f05_handovers(spark, d):
    return Q.handed_over(_readings(spark, d)).where("control is not null").select("worker", "seq")


@query(None)
def f10_quality(spark, d):
    """No SQL: sessions, screening and holds are recursive; tested by hand cases."""
    rules = Q.Rules(session_gap=86400.0, major_gap=36000.0, loss_window=86400.0, sample_period=20000.0, least_samples=2, warmup=3600.0, calibration=3600.0)
    return Q.readings_gate(Q.handed_over(_readings(spark, d)), rules)


@query("""WITH x AS (SELECT event_id, user_id worker, CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' ELSE 'SAFE' END n, event_type = 'error' e, value FROM events)
SELECT event_id, CASE WHEN e THEN 'EMERGENCY' ELSE n END AS state, CASE WHEN e THEN 'followEmergencyProcedure,seekAssistance,remainSafeLocation' ELSE concat_ws(',', CASE n WHEN 'CRITICAL' THEN 'reduceNoiseExposure' WHEN 'WARNING' THEN 'monitorNoiseExposure' END,
CASE WHEN abs((value - 30) / 30 * 100) >= 20 THEN 'checkWorkerCondition' END, CASE WHEN n = 'SAFE' AND abs((value - 30) / 30 * 100) < 20 THEN 'continueMonitoring' END) END actions, CAST(n <> 'SAFE' AS INT) + CAST(abs((value - 30) / 30 * 100) >= 20 AS INT) attention FROM x""")
def l09_guidance(spark, d):
    return V.guidance_document(samples(spark, d), 30.0, (30, 60), 20.0)


@query("SELECT DISTINCT worker, CASE WHEN e THEN 'EMERGENCY' WHEN s = 'SAFE' AND u THEN 'UNCERTAIN' ELSE s END AS state FROM (SELECT user_id worker, bool_or(event_type = 'error' AND ts >= TIMESTAMP '2024-01-30 00:00:00') e, CASE WHEN arg_max(value, (ts, event_id)) >= 60 THEN 'CRITICAL' WHEN arg_max(value, (ts, event_id)) >= 30 THEN 'WARNING' ELSE 'SAFE' END s, arg_max(event_type, (ts, event_id)) = 'signup' u FROM events GROUP BY 1)")
def l13_status_events(spark, d):
    pressed = samples(spark, d).where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))).select("worker")
    seen = samples(spark, d).select(F.col("worker").alias("worker_id")).distinct()
    return V.status(seen, samples(spark, d), _states(spark, d), pressed, _now(), 180).select(F.col("worker_id").alias("worker"), "state")


@query("SELECT user_id worker, count(*) n, count(*) FILTER (event_type = 'error') errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS share FROM events GROUP BY 1")
def l16_reason_shares(spark, d):
    return V.reason_shares(samples(spark, d), "worker", F.col("event_type") == "error")


@query("""SELECT user_id worker, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) place, value heart_rate, CASE WHEN event_id % 3 = 0 THEN NULL WHEN value <> -1 THEN value / 2 END gas, CASE WHEN event_id % 7 = 0 THEN 'NO_TIME' END problem FROM events WHERE user_id % 2 = 0
UNION ALL SELECT user_id, NULL, NULL, NULL, NULL, 'NO_HELMET' FROM events WHERE user_id % 2 = 1 GROUP BY 1""")
def a07_uploads(spark, d):
    k, v = F.col("event_id"), F.col("value")
    sample = F.struct(
        F.when(k % 7 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), v.cast("string").alias("heartRate"), F.when(k % 3 == 0, "-1").otherwise((v / 2).cast("string")).alias("gas"), k.alias("bodyTemp")
    )
    lists = samples(spark, d).groupBy("worker").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), sample.alias("s")))).alias("l"))
    packets = lists.select("worker", F.to_json(F.struct(F.when(F.col("worker") % 2 == 0, "H").alias("helmetId"), F.transform("l", lambda x: x["s"]).alias("samples"))).alias("value"))
    rows = X.uploads(packets.withColumnRenamed("worker", "sender"))
    return rows.select(F.col("sender").alias("worker"), F.col("body_temperature").cast("long").alias("event_id"), "place", "heart_rate", "gas", "problem")


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'UNCERTAIN' ELSE event_type END AS state, CASE WHEN user_id % 4 = 0 THEN 'WORKER_NOT_FOUND' END reason FROM events")
def l23_unknown_workers(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("worker_id"))
    return V.of_known_workers(samples(spark, d).select("event_id", "worker", F.col("event_type").alias("state")), known).select("event_id", "state", "reason")
