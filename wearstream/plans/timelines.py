"""Timelines of the events, of which a gap of 12 hours ends a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearstream.functions import scalars as S
from wearstream.operators import timelines as T
from wearstream.operators import windows as W
from wearstream.plans.registry import query
from wearstream.sources.tables import samples

HOUR = 3600
SESSIONS = """s AS (SELECT event_id, user_id worker, epoch_us(ts) us, ts, value, event_type FROM events),
x AS (SELECT *, CAST(coalesce(us - lag(us) OVER (PARTITION BY worker ORDER BY us, event_id) > 43200000000, false) AS INT) f FROM s),
y AS (SELECT * EXCLUDE (f), CAST(sum(f) OVER (PARTITION BY worker ORDER BY us, event_id) AS BIGINT) AS session FROM x)"""
LEVEL = "CASE WHEN value >= 60 THEN 2 WHEN value >= 30 THEN 1 ELSE 0 END"
VOTES = f"""l AS (SELECT *, {LEVEL} AS level FROM y WHERE event_type <> 'signup'), m AS (SELECT *, CASE WHEN c2 >= c1 AND c2 >= c0 THEN 2 WHEN c1 >= c0 THEN 1 ELSE 0 END smoothed FROM (
  SELECT *, count(*) FILTER (level = 0) OVER w c0, count(*) FILTER (level = 1) OVER w c1, count(*) FILTER (level = 2) OVER w c2 FROM l WINDOW w AS (PARTITION BY worker, session ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"""
SEGMENTS = """t AS (SELECT *, CASE WHEN event_type IN ('error', 'signup') THEN 'UNCERTAIN' WHEN value >= 60 THEN 'CRITICAL' ELSE 'SAFE' END AS state, event_type reason, CASE WHEN event_type = 'click' THEN 'IMPUTED' ELSE 'VALID' END quality, value / 701 confidence FROM s),
g AS (SELECT *, CASE WHEN state = 'UNCERTAIN' THEN reason END why FROM t),
h AS (SELECT *, CASE WHEN coalesce(state = lag(state) OVER w AND why IS NOT DISTINCT FROM lag(why) OVER w AND us - lag(us) OVER w <= 172800000000, false) THEN 0 ELSE 1 END new FROM g WINDOW w AS (PARTITION BY worker ORDER BY us, event_id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY worker ORDER BY us, event_id) AS BIGINT) segment FROM h),
c AS (SELECT worker, segment, any_value(state) AS state, any_value(why) reason, min(us) from_us, max(us) to_us, count(*) n, round(avg(confidence), 4) confidence,
  CASE WHEN any_value(state) = 'UNCERTAIN' THEN 'UNCERTAIN' WHEN bool_or(quality = 'IMPUTED') THEN 'IMPUTED' ELSE 'VALID' END quality FROM i GROUP BY 1, 2)"""
START = 1_705_276_800_000_000  # 2024-01-15
VISIBLE = f"""d AS (SELECT *, coalesce(follows - to_us <= 172800000000, false) joins, CASE WHEN coalesce(follows - to_us <= 172800000000, false) THEN greatest(follows, to_us) ELSE to_us + 60000000 END AS end
  FROM (SELECT *, lead(from_us) OVER (PARTITION BY worker ORDER BY segment) follows FROM c)), v AS (SELECT *, greatest(from_us, {START}) AS start FROM d WHERE d.end >= {START})"""


def _sessions(spark, d):
    return W.sessions(W.with_micros(samples(spark, d)), 12 * HOUR)


def _voted(spark, d):
    rows = _sessions(spark, d).withColumn("level", F.when(F.col("value") >= 60, 2).when(F.col("value") >= 30, 1).otherwise(0))
    return T.votes(rows, F.col("event_type") != "signup", 5)


def _graded(spark, d):
    kind, v = F.col("event_type"), F.col("value")
    state = F.when(kind.isin("error", "signup"), "UNCERTAIN").when(v >= 60, "CRITICAL").otherwise("SAFE")
    return W.with_micros(samples(spark, d)).withColumns({"state": state, "reason": kind, "quality": F.when(kind == "click", "IMPUTED").otherwise("VALID"), "confidence": v / 701})


def _segments(spark, d):
    return T.compressed(_graded(spark, d), 48 * HOUR)


@query(f"""WITH {SESSIONS} SELECT event_id, round(avg(value) OVER a, 6) mean, round(10 * log10(avg(pow(10, value / 10 / 10)) OVER b), 6) leq, round((avg(value) OVER a - 30) / 30 * 100, 6) "percent" FROM y
WINDOW a AS (PARTITION BY worker, session ORDER BY us RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW), b AS (PARTITION BY worker, session ORDER BY us RANGE BETWEEN 17999999999 PRECEDING AND CURRENT ROW)""")
def e05_signals(spark, d):
    rows = T.signal(T.signal(_sessions(spark, d), 10 * HOUR, "mean", "mean"), 10 * HOUR, "percent", "percent", F.lit(30.0))
    rows = T.signal(rows.withColumn("value", F.col("value") / 10), 5 * HOUR, "leq", "leq")
    return rows.select("event_id", *[F.round(c, 6).alias(c) for c in ("mean", "leq", "percent")])


@query(f"""WITH {SESSIONS}, z AS (SELECT *, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, CASE WHEN event_type = 'view' THEN least(greatest(coalesce((us - lag(us) OVER (PARTITION BY worker, session ORDER BY us, event_id)) / 1e6, 3600), 0), 3600) ELSE 0 END credit FROM y)
SELECT event_id, day, round(log10(1 + sum(credit * CASE WHEN value < 80 THEN 0.0 ELSE 100.0 / 60.0 / (480.0 / pow(2.0, (value - 85.0) / 3.0)) END) OVER (PARTITION BY worker, day ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) dose_log10 FROM z""")
def e06_dose(spark, d):
    """All events, of which the loudest have doses beyond any rounding to digits; so their logarithms are compared."""
    rows = _sessions(spark, d).withColumn("day", S.site_time(F.col("ts")).cast("date"))
    out = T.shift_dose(rows, S.noise_dose(F.col("value"), F.lit(1.0)), F.col("event_type") == "view", HOUR)
    return out.select("event_id", "day", F.round(F.log10(1 + F.col("dose")), 6).alias("dose_log10"))


@query(f"""WITH {SESSIONS}, o AS (SELECT *, CASE WHEN event_type <> 'signup' THEN value END ov, (us - min(us) OVER (PARTITION BY worker, session)) / 1e6 e FROM y),
p AS (SELECT *, CASE WHEN e < 21600 OR count(ov) OVER (PARTITION BY worker, session ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 3 THEN ov END inc FROM o),
q AS (SELECT *, CASE WHEN count(inc) OVER w >= 3 THEN quantile_cont(inc, 0.5) OVER w END m FROM p WINDOW w AS (PARTITION BY worker, session ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, first_value(CASE WHEN e >= 21600 THEN m END IGNORE NULLS) OVER (PARTITION BY worker, session ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) f FROM q)
SELECT event_id, round(coalesce(CASE WHEN worker = 7 THEN 12.5 END, f, m), 6) baseline, worker <> 7 AND f IS NULL provisional FROM r""")
def e07_calibrated(spark, d):
    rows = _sessions(spark, d).withColumn("value", F.when(F.col("event_type") != "signup", F.col("value")))
    return T.calibrated(rows, 6 * HOUR, 3, F.when(F.col("worker") == 7, 12.5)).select("event_id", F.round("baseline", 6).alias("baseline"), "provisional")


@query(f"WITH {SESSIONS}, {VOTES} SELECT event_id, smoothed FROM m")
def e12_vote(spark, d):
    return _voted(spark, d).select("event_id", "smoothed")


@query(f"WITH {SESSIONS}, {VOTES}, t AS (SELECT *, lag(smoothed) OVER (PARTITION BY worker, session ORDER BY us, event_id) b FROM m) SELECT event_id, worker, b AS before, smoothed FROM t WHERE smoothed <> b OR (b IS NULL AND smoothed <> 0)")
def e13_transitions(spark, d):
    return T.changes(_voted(spark, d), "smoothed").select("event_id", "worker", "before", "smoothed")


@query(f"WITH s AS (SELECT event_id, user_id worker, epoch_us(ts) us, value, event_type FROM events), {SEGMENTS} SELECT * FROM c")
def e14_segments(spark, d):
    return _segments(spark, d)


@query(f"WITH s AS (SELECT event_id, user_id worker, epoch_us(ts) us, value, event_type FROM events), {SEGMENTS}, {VISIBLE} SELECT worker, segment, state, v.start, v.end, joins FROM v")
def e15_visible(spark, d):
    return T.visible(_segments(spark, d), START, 48 * HOUR, 60).select("worker", "segment", "state", "start", "end", "joins")


@query(f"""WITH s AS (SELECT event_id, user_id worker, epoch_us(ts) us, value, event_type FROM events), {SEGMENTS}, {VISIBLE}, k AS (SELECT *, CASE state WHEN 'SAFE' THEN 0 WHEN 'CRITICAL' THEN 2 END lv FROM v)
SELECT worker, segment, k.start us, CAST(lv AS INT) AS level, false AS break FROM k UNION ALL SELECT worker, segment, k.end, CAST(lv AS INT), false FROM k UNION ALL SELECT worker, segment, k.end, NULL, true FROM k WHERE NOT joins""")
def e15_chart(spark, d):
    return T.chart_rows(T.visible(_segments(spark, d), START, 48 * HOUR, 60), {"SAFE": 0, "WARNING": 1, "CRITICAL": 2})


@query(f"""WITH s AS (SELECT event_id, user_id worker, epoch_us(ts) us, value, event_type FROM events WHERE epoch_us(ts) < {START}), {SEGMENTS},
n AS (SELECT event_id, user_id worker, epoch_us(ts) us, value, event_type FROM events), np AS (SELECT *, CASE WHEN event_type IN ('error', 'signup') THEN 'UNCERTAIN' WHEN value >= 60 THEN 'CRITICAL' ELSE 'SAFE' END AS state, CASE WHEN event_type = 'click' THEN 'IMPUTED' ELSE 'VALID' END quality FROM n),
lp AS (SELECT np.*, row_number() OVER (PARTITION BY np.worker, us ORDER BY event_id) k FROM np LEFT JOIN (SELECT worker, max(to_us) t FROM c GROUP BY 1) z ON z.worker = np.worker WHERE t IS NULL OR us > t),
al AS (SELECT worker, to_us us, true old, segment o, state, CASE WHEN state = 'UNCERTAIN' THEN reason END why, from_us, n, confidence * n cs, n cn, quality FROM c
  UNION ALL SELECT worker, us, false, event_id, state, CASE WHEN state = 'UNCERTAIN' THEN event_type END, us, 1, value / 701, 1, CASE WHEN state = 'UNCERTAIN' THEN 'UNCERTAIN' ELSE quality END FROM lp WHERE k = 1),
cu AS (SELECT *, CASE WHEN NOT old AND coalesce(state = lag(state) OVER w AND why IS NOT DISTINCT FROM lag(why) OVER w AND us - lag(us) OVER w <= 172800000000, false) THEN 0 ELSE 1 END new FROM al WINDOW w AS (PARTITION BY worker ORDER BY us, old, o)),
cv AS (SELECT *, CAST(sum(new) OVER (PARTITION BY worker ORDER BY us, old, o) AS BIGINT) seg FROM cu)
SELECT worker, seg AS segment, any_value(state) AS state, any_value(why) reason, min(from_us) from_us, max(us) to_us, CAST(sum(n) AS BIGINT) n, round(sum(cs) / sum(cn), 4) confidence,
  CASE WHEN arg_min(quality, (us, old, o)) = 'VALID' AND bool_or(quality = 'IMPUTED') THEN 'IMPUTED' ELSE arg_min(quality, (us, old, o)) END quality FROM cv GROUP BY 1, 2""")
def e15_live(spark, d):
    rows = _graded(spark, d)
    return T.live(T.compressed(rows.where(F.col("us") < START), 48 * HOUR), rows, 48 * HOUR)


@query("SELECT event_id, row_number() OVER w - 1 place, count(*) OVER (PARTITION BY user_id, epoch_us(ts) // 60000000) in_minute FROM events WINDOW w AS (PARTITION BY user_id, epoch_us(ts) // 60000000 ORDER BY ts, event_id)")
def e16_minutes(spark, d):
    return T.minute_places(W.with_micros(samples(spark, d))).select("event_id", F.col("place").cast("long").alias("place"), "in_minute")


@query(f"""WITH {SESSIONS}, m AS (SELECT worker, session, us // 60000000 AS minute, count(*) n FROM y GROUP BY ALL), o AS (SELECT worker, session, min(minute) a, max(minute) z, arg_max(n, minute) l, CAST(sum(n) AS BIGINT) kept FROM m GROUP BY ALL),
p AS (SELECT *, (z - a + 1) * 60 - (60 - l) + CASE WHEN session = 0 THEN 180 ELSE 0 END expected FROM o) SELECT worker, session, expected, kept, round(100.0::DOUBLE * (expected - kept) / expected, 2) missing_percent FROM p""")
def d23_coverage(spark, d):
    return T.coverage_by_session(_sessions(spark, d), 180)
