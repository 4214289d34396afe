"""Calendar periods, and the analytics that they bound."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearstream.functions import calendar as C
from wearstream.functions import scalars as S
from wearstream.operators import aggregates as A
from wearstream.operators import periods as P
from wearstream.plans.registry import query
from wearstream.sources.tables import ALERTS_SQL, CHANNELS, alerts, samples, table

DAYS = "d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
KINDS = "k AS (SELECT unnest(['daily', 'weekly', 'monthly']) kind)"
FIRST = "CASE kind WHEN 'weekly' THEN date_trunc('week', day) WHEN 'monthly' THEN date_trunc('month', day) ELSE day END"
STEP = "CASE kind WHEN 'weekly' THEN INTERVAL 7 DAY WHEN 'monthly' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END"


def _periods(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in C.PERIODS])))


@query("""WITH t AS (SELECT o_orderkey, format('{:04d}-{:02d}-{:02d}{}', 2019 + o_orderkey % 6, o_orderkey % 14, o_orderkey % 33, CASE WHEN o_orderkey % 11 = 0 THEN 'Z' ELSE '' END) txt FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(txt, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(txt AS DATE) END AS day, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE ['daily', 'weekly', 'monthly'][o_orderkey % 4 + 1] END kind FROM t""")
def i01_checked_dates(spark, d):
    k = F.col("o_orderkey")
    text = F.format_string("%04d-%02d-%02d%s", 2019 + k % 6, k % 14, k % 33, F.when(k % 11 == 0, "Z").otherwise(""))
    kind = F.element_at(F.array(*[F.lit(x) for x in [*C.PERIODS, "yearly"]]), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", C.checked_date(text).alias("day"), C.checked_period(kind).alias("kind"))


@query(f"""WITH {DAYS}, {KINDS}, f AS (SELECT *, CAST({FIRST} AS DATE) f, {STEP} AS step FROM d CROSS JOIN k), g AS (SELECT *, CAST(f - step AS DATE) e FROM f)
SELECT kind, day, f::TIMESTAMP - INTERVAL 330 MINUTE AS start, (f + step)::TIMESTAMP - INTERVAL 330 MINUTE AS end,
CASE kind WHEN 'weekly' THEN strftime(f, '%Y-%m-%d') || ' to ' || strftime(f + 6, '%Y-%m-%d') WHEN 'monthly' THEN strftime(f, '%Y-%m') ELSE strftime(f, '%Y-%m-%d') END AS label,
e::TIMESTAMP - INTERVAL 330 MINUTE previous_start, f::TIMESTAMP - INTERVAL 330 MINUTE previous_end,
CASE kind WHEN 'weekly' THEN strftime(e, '%Y-%m-%d') || ' to ' || strftime(e + 6, '%Y-%m-%d') WHEN 'monthly' THEN strftime(e, '%Y-%m') ELSE strftime(e, '%Y-%m-%d') END previous_label FROM g""")
def i02_boundaries(spark, d):
    return _periods(spark, d).select("kind", "day", C.boundaries(F.col("kind"), F.col("day")).alias("b")).select("kind", "day", "b.*")


@query(f"""WITH {DAYS}, {KINDS}, f AS (SELECT *, CAST({FIRST} AS DATE) f, {STEP} AS step FROM d CROSS JOIN k WHERE day < DATE '1995-02-01')
SELECT kind, day, unnest(CASE WHEN kind = 'daily' THEN [lpad(CAST(h AS VARCHAR), 2, '0') || ':00' for h in range(24)] ELSE [strftime(x, '%Y-%m-%d') for x in generate_series(f, f + step - INTERVAL 1 DAY, INTERVAL 1 DAY)] END) bucket FROM f""")
def i03_buckets(spark, d):
    rows = _periods(spark, d).where("day < date'1995-02-01'")
    return rows.select("kind", "day", F.explode(C.buckets(F.col("kind"), F.col("day"))).alias("bucket"))


@query("SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, CAST(hour(ts + INTERVAL 330 MINUTE) AS INT) AS hour, 330 offset_minutes FROM events")
def i05_local_time(spark, d):
    local = S.site_time(F.col("ts"))
    return samples(spark, d).select("event_id", local.cast("date").alias("day"), F.hour(local).alias("hour"), C.offset_minutes(F.col("ts")).alias("offset_minutes"))


@query("""WITH m AS (SELECT event_id, floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60000000)::BIGINT m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m // 60 < 24 THEN (m // 60) || ' hr ago' ELSE (m // 60 // 24) || ' d ago' END ago FROM m""")
def i06_since(spark, d):
    return samples(spark, d).select("event_id", C.since(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("ago"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+05:30') ELSE 'soon' END txt, ts FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(epoch(date_trunc('second', ts)) AS DOUBLE) WHEN 1 THEN CAST(epoch(date_trunc('second', ts)) - 19800 AS DOUBLE) END epoch,
CASE WHEN event_id % 3 < 2 THEN CAST(ts AS DATE) END local_date, CASE WHEN event_id % 3 < 2 THEN CAST(hour(ts) AS INT) END local_hour FROM t""")
def b02_parsed_time(spark, d):
    k, whole = F.col("event_id") % 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(whole, F.lit("Z"))).when(k == 1, F.concat(whole, F.lit("+05:30"))).otherwise("soon")
    return samples(spark, d).select("event_id", C.parsed_time(text).alias("t")).select("event_id", "t.*")


@query("SELECT count(*) n, min(event_id) first_id, max(event_id) last_id FROM events WHERE ts >= TIMESTAMP '2024-01-07 18:30:00' AND ts < TIMESTAMP '2024-01-14 18:30:00'")
def b12_in_period(spark, d):
    return P.in_period(samples(spark, d), "weekly", "2024-01-10").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || '+05:30' AS local FROM events")
def b20_site_iso(spark, d):
    return samples(spark, d).select("event_id", C.site_iso(F.col("ts")).alias("local"))


@query(f"""WITH {ALERTS_SQL}, r AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-07 18:30:00' AND ts < TIMESTAMP '2024-01-14 18:30:00' AND event_type = 'view'
UNION SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-07 18:30:00' AND ts < TIMESTAMP '2024-01-14 18:30:00' AND event_type = 'click')
SELECT (SELECT count(*) FROM customer) workers, (SELECT count(*) FROM r) active""")
def d02_active_workers(spark, d):
    rows = P.in_period(samples(spark, d), "weekly", "2024-01-10")
    kinds = [rows.where(F.col("event_type") == k).select("worker") for k in ("view", "click")]
    return P.activity(table(spark, d, "customer"), kinds)


@query(f"""WITH u AS (UNPIVOT (SELECT CAST(l_shipdate AS DATE) AS day, {', '.join(CHANNELS)} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-02-28 18:30:00' AND l_shipdate < TIMESTAMP '1995-03-31 18:30:00') ON {', '.join(CHANNELS)} INTO NAME channel VALUE v),
g AS (SELECT channel, strftime(day, '%Y-%m-%d') bucket, round(avg(v), 6) mean FROM u GROUP BY 1, 2),
s AS (SELECT c.channel, strftime(b, '%Y-%m-%d') bucket FROM (VALUES {', '.join(f"('{c}')" for c in CHANNELS)}) c(channel) CROSS JOIN (SELECT unnest(generate_series(DATE '1995-03-01', DATE '1995-03-31', INTERVAL 1 DAY)) b))
SELECT s.channel, s.bucket, mean FROM s LEFT JOIN g USING (channel, bucket)""")
def d06_channel_trend(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts"), *CHANNELS)
    return P.channel_trend(rows, list(CHANNELS), "monthly", "1995-03-15")


@query(f"""WITH u AS (UNPIVOT (SELECT CAST(l_shipdate + INTERVAL 330 MINUTE AS DATE) AS day, {', '.join(CHANNELS)} FROM lineitem) ON {', '.join(CHANNELS)} INTO NAME channel VALUE v)
SELECT channel, count(DISTINCT day) AS days FROM u WHERE {' OR '.join(f"(channel = '{c}' AND v >= {k})" for c, (_, k) in CHANNELS.items())} GROUP BY 1""")
def d07_critical_days(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts"), *CHANNELS)
    return P.critical_days(rows, {c: k for c, (_, k) in CHANNELS.items()})


@query("SELECT user_id worker, max(CAST(floor(value) AS BIGINT)) longest FROM events WHERE event_type = 'view' GROUP BY 1 HAVING max(CAST(floor(value) AS BIGINT)) > 0 ORDER BY 2 DESC, 1 LIMIT 10")
def d10_streaks(spark, d):
    rows = samples(spark, d).where("event_type = 'view'").withColumn("counter", F.floor("value"))
    return A.longest_streaks(rows, "counter", top=10)


@query(f"""WITH {ALERTS_SQL}, x AS (SELECT ts >= TIMESTAMP '2024-01-14 18:30:00' AS now, value, kind FROM a JOIN events USING (event_id, ts) WHERE ts >= TIMESTAMP '2024-01-07 18:30:00' AND ts < TIMESTAMP '2024-01-21 18:30:00'),
g AS (SELECT count(*) FILTER (now AND kind = 'WARNING') w1, count(*) FILTER (NOT now AND kind = 'WARNING') w0, count(*) FILTER (now AND kind = 'CRITICAL') c1, count(*) FILTER (NOT now AND kind = 'CRITICAL') c0,
  floor(avg(value) FILTER (now) * 10 + 0.5) / 10 m1, avg(value) FILTER (NOT now) m0 FROM x),
r AS (SELECT unnest([{{'measure': 'warnings', 'now': w1::DOUBLE, 'before': w0::DOUBLE}}, {{'measure': 'criticals', 'now': c1::DOUBLE, 'before': c0::DOUBLE}}, {{'measure': 'mean_value', 'now': m1, 'before': round(m0, 6)}}], recursive := true) FROM g)
SELECT measure, now, before, CASE WHEN now = 0 AND before = 0 THEN 0.0 WHEN before <> 0 THEN floor((now - before) / abs(before) * 100.0 * 10 + 0.5) / 10 END change FROM r""")
def d14_comparison(spark, d):
    rows = samples(spark, d).withColumn("kind", S.alert_kind(F.col("event_type")))
    return P.comparison(rows, "weekly", "2024-01-17")


@query(f"WITH {ALERTS_SQL} SELECT count(*) alerts_today FROM a WHERE ts + INTERVAL 330 MINUTE >= TIMESTAMP '2024-01-20 00:00:00' AND ts + INTERVAL 330 MINUTE < TIMESTAMP '2024-01-21 00:00:00'")
def d16_alerts_today(spark, d):
    return P.in_period(alerts(spark, d), "daily", "2024-01-20").agg(F.count("*").alias("alerts_today"))


@query(f"WITH {ALERTS_SQL} SELECT event_id, worker, kind, ts FROM a WHERE kind <> 'SAFE' AND ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 10")
def l03_recent_alerts(spark, d):
    return P.recent(alerts(spark, d).where("kind <> 'SAFE'"), "2024-01-31 00:00:00", days=7, top=10)
