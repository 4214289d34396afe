"""Whole views over the tables, each as one long table of all its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearstream.functions import channels as N
from wearstream.functions import scalars as S
from wearstream.operators import dashboards as D
from wearstream.plans.registry import query
from wearstream.plans.sites import HELMETS, _now
from wearstream.sources.tables import ALERTS_SQL, alerts, helmets, samples, table, workers

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
ONLINE_SECONDS = 12 * 3600
START, END, BEFORE = "TIMESTAMP '2024-01-14 18:30:00'", "TIMESTAMP '2024-01-21 18:30:00'", "TIMESTAMP '2024-01-07 18:30:00'"
#: Each channel's value of an event, as SQL.
CHANNEL_SQL = {"ambientTemperature": "value / 2", "noise": "CASE WHEN event_type <> 'error' THEN value END", "gas": "value * 5", "uv": "CAST(event_id % 12 AS DOUBLE)"}
READINGS = f"""r AS (SELECT event_id, user_id worker, ts, {', '.join(f'{x} AS "{c}"' for c, x in CHANNEL_SQL.items())}, value AS "heartRate", value / 2 AS "bodyTemperature",
  CASE WHEN value < 90 AND event_type <> 'error' THEN {{'lat': value, 'lon': value * 2}} END gps FROM events)"""
STANDING = f"""lst AS (SELECT user_id w, arg_max(value, (ts, event_id)) v, arg_max(event_type, (ts, event_id)) t, max(ts) seen FROM events GROUP BY 1), em AS (SELECT DISTINCT user_id e FROM events WHERE event_type = 'error' AND ts >= {NOW} - INTERVAL 1 DAY),
sta AS (SELECT w, CASE WHEN t = 'signup' THEN NULL WHEN v >= 60 THEN 'CRITICAL' WHEN v >= 30 THEN 'WARNING' WHEN v IS NOT NULL THEN 'SAFE' END AS state, t = 'signup' uncertain FROM lst),
sd AS (SELECT worker_id, name, state, CASE WHEN state = 'UNCERTAIN' THEN 'SENSOR_WARMUP' END reason FROM (SELECT c_custkey worker_id, c_name AS name, CASE WHEN e IS NOT NULL THEN 'EMERGENCY' WHEN state IN ('WARNING', 'CRITICAL') THEN state WHEN uncertain THEN 'UNCERTAIN' ELSE coalesce(state, 'UNKNOWN') END AS state
  FROM customer LEFT JOIN sta ON w = c_custkey LEFT JOIN em ON e = c_custkey))"""


def _level(channel: str, x: str) -> str:
    first, last, inclusive = N.RANGES[channel]
    return f"CASE WHEN {x} < {first} THEN 'SAFE' WHEN {x} <{'=' if inclusive else ''} {last} THEN 'WARNING' WHEN {x} IS NOT NULL THEN 'CRITICAL' END"


def _part(part: str, item: str, numbers: str, texts: str, source: str) -> str:
    """SQL of one part: columns named in numbers and texts, times as microseconds."""
    n, t = numbers.split(), texts.split()
    number = [f"CAST({'epoch_us(' + c + ')' if c in ('ts', 'seen', 'position_at') else c} AS DOUBLE)" for c in n] + ["NULL::DOUBLE"] * len(t)
    text = ["NULL::VARCHAR"] * len(n) + [f"CAST({c} AS VARCHAR)" for c in t]
    return f"SELECT '{part}' part, CAST({item} AS VARCHAR) item, unnest([{', '.join(repr(c) for c in n + t)}]) AS name, unnest([{', '.join(number)}]) AS number, unnest([{', '.join(text)}]) AS text FROM {source}"


def _site_packets(spark, d):
    """Events as packets with every channel and a position."""
    v, k = F.col("value"), F.col("event_id")
    place = F.when(F.col("event_type") != "error", S.gps(v, v * 2))
    noise = F.when(F.col("event_type") != "error", v)
    return samples(spark, d).select(
        "event_id", "worker", "ts", (v / 2).alias("ambientTemperature"), noise.alias("noise"), (v * 5).alias("gas"), (k % 12).cast("double").alias("uv"), v.alias("heartRate"), (v / 2).alias("bodyTemperature"), place.alias("gps")
    )


def _texts(factors: str):
    value = lambda f: F.when(f["value"].isNotNull(), F.format_string("%.1f", f["value"]))
    return F.transform(factors, lambda f: F.concat_ws(":", f["factor"], f["severity"], value(f), f["detail"]))


def _states(spark, d):
    last = samples(spark, d).groupBy("worker").agg(F.max_by(F.struct("value", "event_type"), F.struct("ts", "event_id")).alias("x"))
    doubt = F.col("x.event_type") == "signup"
    return last.select("worker", F.when(~doubt, S.classified(F.col("x.value"), 30, 60)).alias("state"), doubt.alias("uncertain"), F.when(doubt, "SENSOR_WARMUP").alias("reason"))


def _pressed(spark, d):
    return samples(spark, d).where((F.col("event_type") == "error") & (F.col("ts") >= _now() - F.expr("interval '1' day"))).select("worker")


def _raised(spark, d):
    return alerts(spark, d).where("kind <> 'SAFE'")


@query(f"""WITH {ALERTS_SQL}, {HELMETS}, {READINGS}, {STANDING}, on_ AS (SELECT count(*) registered, count(*) FILTER (o) online, count(*) FILTER (NOT o) offline, count(wearer) assigned, coalesce(floor(count(*) FILTER (o) * 100.0::DOUBLE / nullif(count(*), 0) * 10 + 0.5) / 10, 0) online_percent
  FROM (SELECT wearer, coalesce(seen >= {NOW} - INTERVAL {ONLINE_SECONDS} SECOND, false) o FROM h LEFT JOIN lst ON w = wearer)),
su AS (SELECT (SELECT count(*) FROM sd) workers, (SELECT count(*) FROM sd WHERE state = 'SAFE') safe, (SELECT count(*) FROM a WHERE kind <> 'SAFE' AND ts >= TIMESTAMP '2024-01-30 18:30:00' AND ts < TIMESTAMP '2024-01-31 18:30:00') alerts_today, online FROM on_),
re AS (SELECT * FROM a WHERE kind <> 'SAFE' AND ts >= {NOW} - INTERVAL 7 DAY AND ts < {NOW} ORDER BY ts DESC, event_id DESC LIMIT 10),
po AS (SELECT worker, arg_max(gps, (ts, event_id)) gps, max(ts) position_at FROM r WHERE gps IS NOT NULL GROUP BY 1),
lo AS (SELECT worker_id, gps.lat lat, gps.lon lon, seen, state, name, reason, position_at, CAST(epoch_us({NOW}) - epoch_us(seen) <= {ONLINE_SECONDS}000000 AS INT) online FROM sd JOIN po ON worker = worker_id JOIN lst ON w = worker_id WHERE worker_id IN (SELECT wearer FROM h WHERE active))
{_part("summary", "''", "workers safe alerts_today online", "", "su")} UNION ALL {_part("workers", "state", "workers", "", "(SELECT state, count(*) workers FROM sd GROUP BY 1)")} UNION ALL {_part("helmets", "''", "registered online offline assigned online_percent", "", "on_")}
UNION ALL {_part("alerts", "event_id", "worker ts", "kind", "re")} UNION ALL {_part("locations", "worker_id", "lat lon seen position_at online", "state name reason", "lo")}""")
def l01_admin(spark, d):
    """All of the admin's dashboard but the weather."""
    return D.assembled(D.admin_dashboard(workers(spark, d), helmets(spark, d), _site_packets(spark, d), _raised(spark, d), _states(spark, d), _pressed(spark, d), "2024-01-31 00:00:00", seconds=ONLINE_SECONDS))


@query(f"""WITH {ALERTS_SQL}, {HELMETS}, {READINGS}, {STANDING}, he AS (SELECT worker_id, helmet, seen, CASE WHEN seen IS NOT NULL THEN CAST(epoch_us({NOW}) - epoch_us(seen) <= {ONLINE_SECONDS}000000 AS INT) END online FROM sd JOIN (SELECT wearer, min(helmet) helmet FROM h WHERE wearer IS NOT NULL GROUP BY 1) ON wearer = worker_id LEFT JOIN lst ON w = worker_id),
se AS (SELECT * FROM r JOIN customer ON c_custkey = worker QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) = 1),
re AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) place FROM a JOIN customer ON c_custkey = worker WHERE kind <> 'SAFE' AND ts >= {NOW} - INTERVAL 7 DAY AND ts < {NOW} QUALIFY place <= 5)
{_part("status", "worker_id", "", "name state reason", "sd")} UNION ALL {_part("helmet", "worker_id", "helmet online seen", "", "he")}
UNION ALL {_part("sensors", "worker", "ts ambientTemperature noise gas uv heartRate bodyTemperature", "", "se")} UNION ALL {_part("alerts", "worker || '/' || place", "event_id ts", "kind", "re")}""")
def l02_workers(spark, d):
    """All of every worker's dashboard but the weather."""
    return D.assembled(D.worker_dashboards(workers(spark, d), helmets(spark, d), _site_packets(spark, d), _raised(spark, d), _states(spark, d), _pressed(spark, d), "2024-01-31 00:00:00", seconds=ONLINE_SECONDS))


@query(f"""WITH {STANDING}, x AS (SELECT event_id, user_id worker, epoch_us(ts) us, ts, value / 100 confidence, event_type IN ('error', 'signup') doubt, event_type <> 'view' AND event_id % 7 > 0 voted, CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' WHEN value IS NOT NULL THEN 'SAFE' END sm, event_type,
  CASE WHEN event_id % 5 = 0 THEN 'IMPUTED' ELSE 'VALID' END quality FROM events JOIN customer ON c_custkey = user_id),
ac AS (SELECT worker, ts, sm AS state, confidence FROM x WHERE voted AND NOT doubt AND sm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) = 1),
t AS (SELECT *, CASE WHEN doubt THEN 'UNCERTAIN' ELSE sm END AS state, CASE WHEN NOT doubt THEN confidence END c, CASE WHEN doubt THEN event_type ELSE '' END why FROM x WHERE ts >= TIMESTAMP '2024-01-19 18:30:00' AND ts < TIMESTAMP '2024-01-20 18:30:00' AND (doubt OR voted AND sm IS NOT NULL)),
g AS (SELECT *, CASE WHEN coalesce(state = lag(state) OVER v AND us - lag(us) OVER v <= 36000000000 AND why = lag(why) OVER v, false) THEN 0 ELSE 1 END fresh FROM t WINDOW v AS (PARTITION BY worker ORDER BY us, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY worker ORDER BY us, event_id) segment FROM g),
sg AS (SELECT worker || '/' || CAST(segment AS BIGINT) item, any_value(state) AS state, nullif(any_value(why), '') reason, min(us) from_us, max(us) to_us, count(*) n, round(avg(c), 4) confidence, CASE WHEN any_value(doubt) THEN 'UNCERTAIN' WHEN bool_or(quality = 'IMPUTED') THEN 'IMPUTED' ELSE 'VALID' END quality FROM i GROUP BY worker, segment)
{_part("status", "worker_id", "", "name state reason", "sd")} UNION ALL {_part("latest", "worker", "ts confidence", "state", "ac")} UNION ALL {_part("today", "item", "from_us to_us n confidence", "state reason quality", "sg")}""")
def l06_histories(spark, d):
    """Status, latest accepted vote and a local day's segments of every worker."""
    v, k, kind = F.col("value"), F.col("event_id"), F.col("event_type")
    doubt = kind.isin("error", "signup")
    rows = samples(spark, d).select(
        "worker", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), ((kind != "view") & (k % 7 > 0)).alias("accepted"), S.classified(v, 30, 60).alias("smoothed"),
        F.when(doubt, "UNCERTAIN").otherwise(S.classified(v, 30, 60)).alias("state"), (v / 100).alias("confidence"), F.when(k % 5 == 0, "IMPUTED").otherwise("VALID").alias("quality"), F.when(doubt, kind).alias("reason"),
    )
    return D.assembled(D.prediction_histories(workers(spark, d), rows, _states(spark, d), _pressed(spark, d), "2024-01-20", gap_seconds=10 * 3600))


def _beside(x: str, baseline: str) -> str:
    p = f"(({x} - {baseline}) / {baseline} * 100.0)"
    return f"CAST(floor(abs{p} * 10 + 0.5) / 10 AS DECIMAL(18, 1)) || CASE WHEN {p} >= 0 THEN ' % over the baseline' ELSE ' % under the baseline' END"


def _shown(name: str, severity: str, x: str, detail: str, attention: str = "false") -> str:
    return f"{{'s': {severity}, 'a': {attention}, 't': concat_ws(':', '{name}', {severity}, CAST(floor({x} * 10 + 0.5) / 10 AS DECIMAL(18, 1)), {detail})}}"


_SITE_SQL = [f"CASE WHEN {_level(c, f'p.{c}')} <> 'SAFE' THEN " + _shown(c, _level(c, f"p.{c}"), f"p.{c}", f"CASE {_level(c, f'p.{c}')} WHEN 'CRITICAL' THEN 'in the critical range' ELSE 'in the warning range' END") + " END" for c in N.RANGES]
_BODY_SQL = [f"CASE WHEN {b} > 0 AND p.{c} IS NOT NULL THEN " + _shown(c, "'INFO'", f"p.{c}", _beside(f"p.{c}", b), a) + " END" for c, b, a in (("heartRate", "heart", "abs((p.heartRate - heart) / heart * 100.0) >= 20"), ("bodyTemperature", "body", "false"))]
_ACTION_SQL = {"ambientTemperature": ("moveToCoolerArea", "hydrateAndRest"), "noise": ("reduceNoiseExposure", "monitorNoiseExposure"), "gas": ("leaveOrVentilateArea", "monitorGasLevel"), "uv": ("avoidDirectSun", "useSunProtection")}
_TODO_SQL = [f"CASE {_level(c, f'p.{c}')} WHEN 'CRITICAL' THEN {{'r': 0, 'p': {i}, 'k': '{hard}'}} WHEN 'WARNING' THEN {{'r': 1, 'p': {i}, 'k': '{soft}'}} END" for i, (c, (hard, soft)) in enumerate(_ACTION_SQL.items())]


@query(f"""WITH {HELMETS}, {READINGS}, {STANDING}, l AS (SELECT worker, arg_max(r, (ts, event_id)) p FROM r GROUP BY 1), j AS (SELECT c_custkey worker_id, p, e IS NOT NULL urgent, coalesce(uncertain, false) doubt, CASE WHEN NOT coalesce(uncertain, false) OR state IN ('WARNING', 'CRITICAL') THEN state END risk,
  c_custkey IN (SELECT wearer FROM h WHERE wearer IS NOT NULL) worn, 20.0 + c_custkey % 50 heart, CAST(c_nationkey AS DOUBLE) body FROM customer LEFT JOIN l ON worker = c_custkey LEFT JOIN em ON e = c_custkey LEFT JOIN sta ON w = c_custkey),
o AS (SELECT *, worn AND p IS NOT NULL live, CASE WHEN worn AND p IS NOT NULL THEN epoch_us({NOW}) - epoch_us(p.ts) <= {ONLINE_SECONDS}000000 END online FROM j),
f AS (SELECT *, list_filter([{', '.join(_SITE_SQL + _BODY_SQL)}, CASE WHEN NOT online THEN {{'s': 'WARNING', 'a': false, 't': 'helmetCommunication:WARNING:nothing is heard from the helmet'}} END], lambda z: z IS NOT NULL) u,
  coalesce(heart > 0 AND abs((p.heartRate - heart) / heart * 100.0) >= 20, false) needs FROM o),
g AS (SELECT *, list_concat(list_filter(u, lambda z: z.s = 'CRITICAL'), list_filter(u, lambda z: z.s = 'WARNING'), list_filter(u, lambda z: z.s = 'INFO')) fs,
  list_filter([{', '.join(_TODO_SQL)}, CASE WHEN needs THEN {{'r': 1, 'p': 20, 'k': 'checkWorkerCondition'}} END, CASE WHEN NOT online THEN {{'r': 1, 'p': 21, 'k': 'restoreCommunication'}} END], lambda z: z IS NOT NULL) c1 FROM f),
b AS (SELECT *, list_concat(c1, list_filter([CASE WHEN len(c1) = 0 AND risk = 'CRITICAL' THEN {{'r': 0, 'p': 22, 'k': 'checkWorkerCondition'}} WHEN len(c1) = 0 AND risk = 'WARNING' THEN {{'r': 1, 'p': 22, 'k': 'checkWorkerCondition'}} END, CASE WHEN doubt AND risk IS NULL THEN {{'r': 1, 'p': 23, 'k': 'checkSensors'}} END], lambda z: z IS NOT NULL)) c2,
  CASE WHEN live THEN len(list_filter(fs, lambda z: z.s <> 'INFO' OR z.a)) ELSE 0 END attention,
  CASE WHEN NOT worn THEN 'NO_HELMET' WHEN p IS NULL THEN CASE WHEN urgent THEN 'EMERGENCY' ELSE 'NO_DATA' END WHEN urgent THEN 'EMERGENCY' WHEN risk = 'CRITICAL' OR len(list_filter(fs, lambda z: z.s = 'CRITICAL')) > 0 THEN 'CRITICAL' WHEN risk = 'WARNING' OR len(list_filter(fs, lambda z: z.s = 'WARNING')) > 0 THEN 'WARNING'
    WHEN risk = 'SAFE' THEN 'SAFE' WHEN doubt THEN 'UNCERTAIN' ELSE 'UNKNOWN' END AS state FROM g)
SELECT worker_id, state, CASE WHEN worn THEN risk END risk, worn AND urgent emergency, online, CASE WHEN live THEN p.ts END updated, CASE WHEN live THEN CASE WHEN online THEN 'now' ELSE 'last known' END END readings,
CASE state WHEN 'EMERGENCY' THEN 'Emergency' WHEN 'CRITICAL' THEN 'Act now' WHEN 'WARNING' THEN 'Take care' WHEN 'SAFE' THEN 'All as it should be' WHEN 'UNCERTAIN' THEN 'Not certain' WHEN 'NO_HELMET' THEN 'No helmet' WHEN 'NO_DATA' THEN 'No readings yet' ELSE 'Not known yet' END title,
CASE state WHEN 'EMERGENCY' THEN 'An emergency is on for this worker.' WHEN 'CRITICAL' THEN CASE WHEN attention < 2 THEN '1 condition needs ' ELSE attention || ' conditions need ' END || 'attention at once.' WHEN 'WARNING' THEN CASE WHEN attention < 2 THEN '1 condition needs ' ELSE attention || ' conditions need ' END || 'attention.'
  WHEN 'SAFE' THEN 'The readings are in their usual ranges.' WHEN 'UNCERTAIN' THEN 'The risk for this worker can''t be told now: sensors are still heating up. It may not be safe.' WHEN 'NO_HELMET' THEN 'Guidance begins when a helmet is assigned.' WHEN 'NO_DATA' THEN 'Guidance begins with the first readings.' ELSE 'No state has been found yet.' END AS text,
CASE WHEN live THEN array_to_string(list_transform(fs[1:4], lambda z: z.t), '|') ELSE '' END factors,
CASE WHEN NOT live THEN '' WHEN urgent THEN 'locateCheckWorker,followEmergencyProcedure,emergencyResetAfterCheck' WHEN len(c2) = 0 THEN 'continueMonitoring'
  ELSE array_to_string(list_transform(list_sort(c2), lambda z: z.k)[1:5], ',') END actions, CAST(attention AS INT) attention FROM b""")
def l09_documents(spark, d):
    """Every worker's whole guidance document, as an admin sees it."""
    k = F.col("c_custkey")
    base = table(spark, d, "customer").select(k.alias("worker_id"), (F.lit(20.0) + k % 50).alias("heart"), F.col("c_nationkey").cast("double").alias("body"))
    found = D.guidance_documents(workers(spark, d), helmets(spark, d), _site_packets(spark, d).drop("gps"), base, _states(spark, d), _pressed(spark, d), _now(), seconds=ONLINE_SECONDS, attention_percent=20.0, viewer="ADMIN")
    return found.withColumns({"factors": F.concat_ws("|", _texts("factors")), "actions": F.concat_ws(",", "actions")})


_B11 = " UNION ALL ".join(f"SELECT event_id, '{c}' channel, {_level(c, f'CAST({x} AS DOUBLE)')} AS level FROM b" for c, x in (("ambientTemperature", "y"), ("noise", "y"), ("gas", "y * 4"), ("uv", "event_id % 10")))


@query(f"WITH b AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN floor(value) END y FROM events) {_B11}")
def b11_channels(spark, d):
    """Levels by each channel's own ranges; values are whole, so that the limits themselves occur."""
    whole = F.when(F.col("event_id") % 9 > 0, F.floor("value").cast("double"))
    values = {"ambientTemperature": whole, "noise": whole, "gas": whole * 4, "uv": (F.col("event_id") % 10).cast("double")}
    rows = samples(spark, d).select("event_id", *[N.channel_level(c, x).alias(c) for c, x in values.items()])
    return rows.unpivot(["event_id"], list(values), "channel", "level")


@query(f"""WITH {READINGS}, x AS (SELECT event_id, r p, 20.0 + worker % 50 heart, CAST(worker % 25 AS DOUBLE) body, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END online FROM r),
f AS (SELECT event_id, list_filter([{', '.join(_SITE_SQL + _BODY_SQL)}, CASE WHEN NOT online THEN {{'s': 'WARNING', 'a': false, 't': 'helmetCommunication:WARNING:nothing is heard from the helmet'}} END], lambda z: z IS NOT NULL) u FROM x)
SELECT event_id, array_to_string(list_transform(list_concat(list_filter(u, lambda z: z.s = 'CRITICAL'), list_filter(u, lambda z: z.s = 'WARNING'), list_filter(u, lambda z: z.s = 'INFO')), lambda z: z.t), '|') factors, CAST(len(list_filter(u, lambda z: z.s <> 'INFO' OR z.a)) AS INT) attention FROM f""")
def b35_ranked(spark, d):
    """All factors of every reading in order of severity, and how many need attention."""
    who, k = F.col("worker"), F.col("event_id")
    heard = F.when(k % 3 == 1, True).when(k % 3 == 2, False)
    found = N.factors({c: F.col(c) for c in N.RANGES}, (F.col("heartRate"), F.lit(20.0) + who % 50), (F.col("bodyTemperature"), (who % 25).cast("double")), heard, 20.0)
    rows = _site_packets(spark, d).select("event_id", found.alias("found"))
    return rows.select("event_id", F.concat_ws("|", _texts("found")).alias("factors"), N.attention_count(F.col("found")).alias("attention"))


_IN = f"ts >= {START} AND ts < {END}"
_CHANNELS = ", ".join(f'"{c}"' for c in N.RANGES)
_KINDS = {"total": "kind IN ('WARNING', 'CRITICAL', 'EMERGENCY')", "warning": "kind = 'WARNING'", "critical": "kind = 'CRITICAL'", "emergency": "kind = 'EMERGENCY'"}
_COMPARED = " UNION ALL ".join(
    [f"SELECT '{m}' measure, CAST(count(*) FILTER (kind <> 'SAFE' AND {k} AND ts >= {START}) AS DOUBLE) AS now, CAST(count(*) FILTER (kind <> 'SAFE' AND {k} AND ts < {START}) AS DOUBLE) before FROM bo" for m, k in _KINDS.items()]
    + [f"SELECT 'workers', CAST(count(DISTINCT user_id) FILTER (ts >= {START}) AS DOUBLE), CAST(count(DISTINCT user_id) FILTER (ts < {START}) AS DOUBLE) FROM events WHERE ts >= {BEFORE} AND ts < {END}"]
    + [f"""SELECT '{c}', floor(avg("{c}") FILTER (ts >= {START}) * 10 + 0.5) / 10, round(avg("{c}") FILTER (ts < {START}), 6) FROM r WHERE ts >= {BEFORE} AND ts < {END}""" for c in N.RANGES]
)
_LEVELS = "CASE channel " + " ".join(f"WHEN '{c}' THEN {_level(c, 'v')}" for c in N.RANGES) + " END"
_SAID = " UNION ALL ".join(f"SELECT {4 + i}, '{c} was critical on ' || critical_days || ' days.' FROM env WHERE channel = '{c}' AND critical_days > 0" for i, c in enumerate(N.RANGES))


@query(f"""WITH {ALERTS_SQL}, {HELMETS}, {READINGS}, bo AS (SELECT * FROM a WHERE kind <> 'SAFE' AND ts >= {BEFORE} AND ts < {END}), al AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 50 AS DOUBLE) END acknowledged, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 70 AS DOUBLE) END resolved,
  event_id % 4 = 0 closed, kind = 'EMERGENCY' emergency FROM bo WHERE {_IN}),
co AS (SELECT count(*) FILTER (kind = 'WARNING') warning, count(*) FILTER (kind = 'CRITICAL') critical, count(*) FILTER (kind = 'EMERGENCY') emergency FROM al),
rs AS (SELECT count(*) total, count(acknowledged) answered, count(*) - count(acknowledged) unanswered, floor(count(acknowledged) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 answer_rate, floor(avg(acknowledged) * 10 + 0.5) / 10 mean_minutes, floor(quantile_cont(acknowledged, 0.5) * 10 + 0.5) / 10 median_minutes,
  count(*) FILTER (emergency AND closed) closed_emergencies, count(*) FILTER (emergency AND NOT closed) open_emergencies, floor(avg(resolved) FILTER (emergency) * 10 + 0.5) / 10 mean_resolution, count(resolved) FILTER (emergency) resolutions FROM al WHERE kind IN ('WARNING', 'CRITICAL', 'EMERGENCY')),
hr AS (SELECT wearer, helmet, x IS NOT NULL heard, coalesce(seen >= {NOW} - INTERVAL {ONLINE_SECONDS} SECOND, false) o FROM h LEFT JOIN (SELECT DISTINCT worker x FROM r WHERE {_IN}) ON x = wearer LEFT JOIN (SELECT worker y, max(ts) seen FROM r GROUP BY 1) ON y = wearer WHERE active),
tr AS (SELECT count(*) registered, count(*) FILTER (heard) reporting, count(*) FILTER (NOT heard) silent, count(*) FILTER (o) online, count(*) FILTER (NOT o) offline FROM hr),
su AS (SELECT (SELECT count(*) FROM customer) workers, (SELECT count(DISTINCT user_id) FROM events WHERE {_IN}) with_activity, warning, critical, emergency, warning + critical + emergency total, mean_minutes, CASE WHEN registered > 0 THEN floor(reporting * 100.0::DOUBLE / registered * 10 + 0.5) / 10 END reporting_rate, unanswered, silent FROM co, rs, tr),
cm AS (SELECT *, CASE WHEN now = 0 AND before = 0 THEN 0.0 WHEN before <> 0 THEN floor((now - before) / abs(before) * 100.0 * 10 + 0.5) / 10 END change FROM ({_COMPARED})),
td AS (SELECT strftime(b, '%Y-%m-%d') bucket, count(*) FILTER (kind = 'WARNING') warnings, count(*) FILTER (kind = 'CRITICAL') criticals FROM generate_series(DATE '2024-01-15', DATE '2024-01-21', INTERVAL 1 DAY) s(b) LEFT JOIN al ON CAST(ts + INTERVAL 330 MINUTE AS DATE) = b GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY criticals DESC, emergencies DESC, warnings DESC, alerts DESC, worker) place FROM (SELECT worker, count(*) FILTER (kind = 'CRITICAL') criticals, count(*) FILTER (kind = 'EMERGENCY') emergencies, count(*) FILTER (kind = 'WARNING') warnings, count(*) alerts, arg_max(kind, (ts, event_id)) latest FROM al GROUP BY 1) QUALIFY place <= 10),
rn AS (SELECT rk.*, coalesce(c_name, CAST(worker AS VARCHAR)) AS name FROM rk LEFT JOIN customer ON c_custkey = worker),
u AS (UNPIVOT (SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, {_CHANNELS} FROM r WHERE {_IN}) ON {_CHANNELS} INTO NAME channel VALUE v), ul AS (SELECT *, {_LEVELS} lv FROM u),
env AS (SELECT channel, floor(avg(v) * 10 + 0.5) / 10 mean, min(v) low, max(v) high, count(*) n, count(*) FILTER (lv = 'WARNING') warnings, count(*) FILTER (lv = 'CRITICAL') criticals, count(DISTINCT day) FILTER (lv = 'CRITICAL') critical_days FROM ul GROUP BY 1),
ct AS (SELECT c || '/' || strftime(b, '%Y-%m-%d') item, mean FROM (SELECT unnest([{', '.join(repr(c) for c in N.RANGES)}]) c) CROSS JOIN generate_series(DATE '2024-01-15', DATE '2024-01-21', INTERVAL 1 DAY) s(b) LEFT JOIN (SELECT channel, day, round(avg(v), 6) mean FROM u GROUP BY 1, 2) ON channel = c AND day = b),
dv AS (SELECT worker, arg_max(d, (abs(d), d)) deviation, max(abs(d)) size FROM (SELECT user_id worker, value - 30 d FROM events WHERE {_IN} AND value IS NOT NULL) GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10),
ex AS (SELECT user_id worker, max(CAST(floor(value) AS BIGINT)) longest FROM events WHERE {_IN} GROUP BY 1 HAVING max(CAST(floor(value) AS BIGINT)) > 0 ORDER BY 2 DESC, 1 LIMIT 10),
ho AS (SELECT *, row_number() OVER (ORDER BY criticals DESC, warnings DESC, bucket) place FROM (SELECT hour(ts + INTERVAL 330 MINUTE) bucket, count(*) FILTER (kind = 'WARNING') warnings, count(*) FILTER (kind = 'CRITICAL') criticals FROM al GROUP BY 1) WHERE warnings + criticals > 0 QUALIFY place <= 5),
se AS (SELECT 1 place, 'Most criticals came in the hour from ' || lpad(CAST(bucket AS VARCHAR), 2, '0') || ':00: ' || criticals || ', with ' || warnings || ' warnings.' sentence FROM ho WHERE place = 1 UNION ALL SELECT 2, 'Highest on the list: ' || name || ' with ' || criticals || ' criticals, ' || emergencies || ' emergencies, ' || warnings || ' warnings.' FROM rn WHERE place = 1
  UNION ALL SELECT 3, 'Helmets that sent nothing: ' || silent || '.' FROM su WHERE silent > 0 UNION ALL {_SAID} UNION ALL SELECT 8, 'Emergencies: ' || emergency || '.' FROM su WHERE emergency > 0 UNION ALL SELECT 9, 'Alerts without an answer: ' || unanswered || '.' FROM su WHERE unanswered > 0)
{_part("summary", "''", "workers with_activity warning critical emergency total mean_minutes reporting_rate", "", "su")} UNION ALL {_part("comparison", "measure", "now before change", "", "cm")} UNION ALL {_part("trend", "bucket", "warnings criticals", "", "td")}
UNION ALL {_part("attention", "place", "worker criticals emergencies warnings alerts", "name latest", "rn")} UNION ALL {_part("environment", "channel", "mean low high n warnings criticals critical_days", "", "env")} UNION ALL {_part("channel_trend", "item", "mean", "", "ct")}
UNION ALL {_part("health", "worker", "size deviation", "", "dv")} UNION ALL {_part("exposure", "worker", "longest", "", "ex")} UNION ALL {_part("helmets", "''", "registered reporting silent online offline", "", "tr")} UNION ALL {_part("silent", "helmet", "is_silent", "", "(SELECT helmet, 1 is_silent FROM hr WHERE NOT heard)")}
UNION ALL {_part("response", "''", "total answered unanswered answer_rate mean_minutes median_minutes closed_emergencies open_emergencies mean_resolution resolutions", "", "rs")} UNION ALL {_part("hours", "place", "bucket warnings criticals", "", "ho")} UNION ALL {_part("insights", "place", "", "sentence", "se")}""")
def k04_period(spark, d):
    """All of a period's analytics: a week in January and the one before."""
    k, v = F.col("event_id"), F.col("heartRate")
    packets = _site_packets(spark, d).withColumns({"deviation": v - 30.0, "counter": F.floor(v)})
    answers = {"acknowledged": F.when(k % 3 > 0, (k % 50).cast("double")), "resolved": F.when(k % 4 == 0, (k % 70).cast("double")), "closed": k % 4 == 0, "emergency": F.col("kind") == "EMERGENCY"}
    parts = D.period_summary("weekly", "2024-01-17", _now(), workers=workers(spark, d), helmets=helmets(spark, d), packets=packets, alerts=_raised(spark, d).withColumns(answers), seconds=ONLINE_SECONDS)
    return D.assembled(parts)
