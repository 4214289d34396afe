"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearstream.functions import scalars as S
from wearstream.operators import aggregates as A
from wearstream.operators import joins as J
from wearstream.operators import profiles as P
from wearstream.operators import windows as W
from wearstream.plans import registry
from wearstream.plans.registry import query
from wearstream.sources.tables import ALERTS_SQL, CHANNELS, KIND_SQL, alerts, samples, table, workers
from wearstream.streaming import stateful

HOUR = 3600
KIND, ALERTS = KIND_SQL, ALERTS_SQL
SAMPLES = "s AS (SELECT event_id, user_id worker, epoch_us(ts) us, ts, value, event_type FROM events)"
TREND = "count(*) FILTER (kind = 'WARNING') warnings, count(*) FILTER (kind = 'CRITICAL') criticals"


def _us(spark, d):
    return W.with_micros(samples(spark, d))


@query("SELECT event_id, CASE WHEN value = -1 THEN NULL ELSE value END AS clean FROM events")
def b03_clean(spark, d):
    return samples(spark, d).select("event_id", S.cleaned(F.col("value")).alias("clean"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - 30000, 4) dev, round((l_extendedprice - 30000) / 30000 * 100, 6) dev_percent FROM lineitem")
def b06_deviation(spark, d):
    x = F.col("l_extendedprice").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.deviation(x, F.lit(30000.0)), 4).alias("dev"), F.round(S.deviation_percent(x, F.lit(30000.0)), 6).alias("dev_percent"))


@query("SELECT event_id, round(log10(1 + CASE WHEN value < 80 THEN 0.0 ELSE 100.0 * (60.0 / 60.0) / (480.0 / pow(2.0, (value - 85.0) / 3.0)) END), 6) dose_log10 FROM events")
def b08_noise_dose_inc(spark, d):
    """All events, also those louder than any site; so logarithms are compared."""
    return samples(spark, d).select("event_id", F.round(F.log10(1 + S.noise_dose(F.col("value"), F.lit(60.0))), 6).alias("dose_log10"))


@query("SELECT event_id, CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' ELSE 'SAFE' END AS state FROM events WHERE value IS NOT NULL")
def b11_classify(spark, d):
    return samples(spark, d).where("value is not null").select("event_id", S.classified(F.col("value"), 30, 60).alias("state"))


@query("SELECT event_id, floor((value - 20) * 10 + 0.5) / 10 AS rounded FROM events")
def b14_round_half_up(spark, d):
    return samples(spark, d).select("event_id", S.half_up(F.col("value") - 20, 1).alias("rounded"))


@query(f"WITH {ALERTS} SELECT count(*) FILTER (kind = 'WARNING') warning, count(*) FILTER (kind = 'CRITICAL') critical, count(*) FILTER (kind = 'EMERGENCY') emergency, count(*) FILTER (kind IN ('WARNING', 'CRITICAL', 'EMERGENCY')) total FROM a")
def d01_alert_counts(spark, d):
    return A.alert_counts(alerts(spark, d))


@query(f"WITH {ALERTS}, c AS (SELECT CAST(hour(ts + INTERVAL 330 MINUTE) AS INT) bucket, {TREND} FROM a GROUP BY 1) SELECT CAST(b AS INT) bucket, coalesce(warnings, 0) warnings, coalesce(criticals, 0) criticals FROM range(24) r(b) LEFT JOIN c ON b = bucket")
def d03_trend_hourly(spark, d):
    return A.risk_trend(alerts(spark, d), by="hour")


@query(f"WITH {ALERTS}, c AS (SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) bucket, {TREND} FROM a GROUP BY 1), p AS (SELECT CAST(unnest(generate_series((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c), INTERVAL 1 DAY)) AS DATE) b) SELECT b AS bucket, coalesce(warnings, 0) warnings, coalesce(criticals, 0) criticals FROM p LEFT JOIN c ON b = bucket")
def d03_trend_daily(spark, d):
    return A.risk_trend(alerts(spark, d), by="day")


@query(f"""WITH {ALERTS}, r AS (SELECT worker, count(*) FILTER (kind = 'CRITICAL') criticals, count(*) FILTER (kind = 'EMERGENCY') emergencies, count(*) FILTER (kind = 'WARNING') warnings, count(*) alerts, arg_max(kind, (ts, event_id)) latest
  FROM a GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC, 5 DESC, 1 LIMIT 15)
SELECT worker, coalesce(c_name, CAST(worker AS VARCHAR)) AS name, criticals, emergencies, warnings, alerts, latest FROM r LEFT JOIN customer ON c_custkey = worker""")
def d04_ranking(spark, d):
    return A.worker_ranking(alerts(spark, d), workers(spark, d), top=15)


@query(f"""WITH u AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) {c}' for c in CHANNELS)} FROM lineitem) ON {', '.join(CHANNELS)} INTO NAME channel VALUE v),
t AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {w}::DOUBLE, {k}::DOUBLE)" for c, (w, k) in CHANNELS.items())}) x(channel, w, c)),
g AS (SELECT channel, round(avg(v), 6) mean, min(v) low, max(v) high, count(*) n, count(*) FILTER (v >= w AND v < c) warnings, count(*) FILTER (v >= c) criticals FROM u JOIN t USING (channel) GROUP BY 1)
SELECT *, floor(criticals * 100.0::DOUBLE / n * 10 + 0.5) / 10 critical_percent FROM g""")
def d05_env_summary(spark, d):
    return A.channel_summary(table(spark, d, "lineitem"), CHANNELS)


@query("""WITH x AS (SELECT user_id worker, value - 30.0 dv FROM events WHERE value IS NOT NULL)
SELECT worker, round(avg(abs(dv)), 6) mean_size, arg_max(dv, (abs(dv), dv)) extreme, count(*) FILTER (abs(dv) >= 50) events FROM x GROUP BY 1""")
def d08_deviation_stats(spark, d):
    return A.extreme_deviation(samples(spark, d).withColumn("deviation", F.col("value") - 30.0), least=50.0)


@query(f"WITH {ALERTS} SELECT CAST(hour(ts + INTERVAL 330 MINUTE) AS INT) bucket, {TREND} FROM a GROUP BY 1 HAVING count(*) FILTER (kind IN ('WARNING', 'CRITICAL')) > 0 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 5")
def d13_hours(spark, d):
    return A.risky_hours(alerts(spark, d), top=5)


@query("SELECT event_type, count(*) n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def d24_distribution(spark, d):
    return A.shares(samples(spark, d), "event_type")


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) q10, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.9), 6) q90 FROM events GROUP BY 1")
def d26_quantiles(spark, d):
    return A.group_quantiles(samples(spark, d), "event_type", "value", [0.1, 0.5, 0.9])


@query("""WITH u AS (UNPIVOT (SELECT l_linenumber, CAST(l_quantity AS DOUBLE) l_quantity, CAST(l_discount AS DOUBLE) l_discount FROM lineitem) ON l_quantity, l_discount INTO NAME channel VALUE v)
SELECT channel, round((avg(v) FILTER (l_linenumber = 1) - avg(v) FILTER (l_linenumber = 2)) / nullif(stddev_samp(v) FILTER (l_linenumber <> 1), 0), 6) smd FROM u GROUP BY 1""")
def d27_smd(spark, d):
    line = F.col("l_linenumber")
    return A.mean_difference(table(spark, d, "lineitem"), line == 1, line == 2, line != 1, ["l_quantity", "l_discount"])


CONFUSION = "x AS (SELECT quality, toxic, count(*) n FROM labels GROUP BY ALL), m AS (SELECT CAST(q AS INT) quality, CAST(t AS INT) toxic, coalesce(n, 0) n FROM range(2) a(q) CROSS JOIN range(2) b(t) LEFT JOIN x ON quality = q AND toxic = t)"


@query(f"WITH {CONFUSION} SELECT * FROM m")
def d33_confusion(spark, d):
    return A.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1])


@query(f"""WITH {CONFUSION}, g AS (SELECT c AS class, CAST(sum(n) FILTER (quality = c) AS BIGINT) support, sum(n) FILTER (quality = c AND toxic = c) hits, sum(n) FILTER (toxic = c) nm FROM m, (SELECT CAST(unnest([0, 1]) AS INT) c) GROUP BY 1),
p AS (SELECT class, support, coalesce(hits / nullif(nm, 0), 0) p, coalesce(hits / nullif(support, 0), 0) r FROM g)
SELECT class, support, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) f1 FROM p""")
def d34_metrics(spark, d):
    return A.class_metrics(d33_confusion(spark, d), "quality", "toxic")


@query(f"WITH {SAMPLES} SELECT event_id, round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 6) roll_mean, round(CASE WHEN count(value) OVER w >= 3 THEN stddev_samp(value) OVER w END, 6) roll_std FROM s WINDOW w AS (PARTITION BY worker ORDER BY us RANGE BETWEEN 107999999999 PRECEDING AND CURRENT ROW)")
def e01_roll_mean(spark, d):
    return W.rolling(_us(spark, d), 30 * HOUR, 3).select("event_id", F.round("roll_mean", 6).alias("roll_mean"), F.round("roll_std", 6).alias("roll_std"))


@query(f"""WITH {SAMPLES} SELECT event_id, round(CASE WHEN count(value) OVER h >= 1 AND count(value) OVER t >= 1 THEN (quantile_cont(value, 0.5) OVER t - quantile_cont(value, 0.5) OVER h) / 144000 * 60 END, 8) trend FROM s
WINDOW h AS (PARTITION BY worker ORDER BY us RANGE BETWEEN 215999999999 PRECEDING AND 144000000000 PRECEDING), t AS (PARTITION BY worker ORDER BY us RANGE BETWEEN 71999999999 PRECEDING AND CURRENT ROW)""")
def e03_trend(spark, d):
    return W.median_split(_us(spark, d), 60 * HOUR, 20 * HOUR, 1).select("event_id", F.round("trend", 8).alias("trend"))


@query(f"""WITH {SAMPLES}, x AS (SELECT *, value >= 20 act, lag(value >= 20) OVER w pa, us - lag(us) OVER w gap FROM s WINDOW w AS (PARTITION BY worker ORDER BY us)),
y AS (SELECT *, CASE WHEN act AND (pa IS NULL OR NOT pa OR gap > 172800000000) THEN us END began FROM x)
SELECT event_id, round(CASE WHEN act THEN 1.0 + (us - last_value(began IGNORE NULLS) OVER (PARTITION BY worker ORDER BY us)) / 1e6 ELSE 0.0 END, 6) exposure FROM y""")
def e04_exposure(spark, d):
    return W.exposure(_us(spark, d), F.col("value") >= 20, 48 * HOUR).select("event_id", F.round("exposure", 6).alias("exposure"))


@query(f"""WITH {SAMPLES}, x AS (SELECT event_id, worker, us, CASE WHEN event_type = 'view' THEN value END v FROM s), y AS (SELECT *, last_value(v IGNORE NULLS) OVER w lv, last_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER w t FROM x WINDOW w AS (PARTITION BY worker ORDER BY us))
SELECT event_id, CASE WHEN us - t <= 36000000000 THEN lv END held, CASE WHEN v IS NOT NULL THEN 'OBSERVED' WHEN us - t <= 36000000000 THEN 'IMPUTED' ELSE 'UNAVAILABLE' END origin FROM y""")
def e08_locf(spark, d):
    return W.held(_us(spark, d).withColumn("value", F.when(F.col("event_type") == "view", F.col("value"))), 10 * HOUR).select("event_id", "held", "origin")


@query(f"""WITH {SAMPLES}, x AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY worker ORDER BY us, event_id) > 43200000000 THEN 1 ELSE 0 END f FROM s)
SELECT event_id, CAST(sum(f) OVER (PARTITION BY worker ORDER BY us, event_id) AS BIGINT) AS session FROM x""")
def e16_sessions(spark, d):
    return W.sessions(_us(spark, d), 12 * HOUR).select("event_id", "session")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def c07_anti(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return J.without(table(spark, d, "supplier"), nations, "s_nationkey").select("s_suppkey")


@query(f"WITH {ALERTS} SELECT worker, arg_max(kind, (ts, event_id)) latest, max(ts) seen FROM a GROUP BY 1")
def c09_latest_state(spark, d):
    return J.latest_state(alerts(spark, d), "worker", "kind")


@query("SELECT DISTINCT k FROM (SELECT user_id k FROM events UNION ALL SELECT c_custkey FROM customer)")
def h02_union_distinct(spark, d):
    ids = [samples(spark, d).select(F.col("worker").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))]
    return J.concatenated(ids).distinct()


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 50 BETWEEN -90 AND 90 AND s_nationkey * 10.0 BETWEEN -180 AND 180 THEN s_acctbal / 50 END lat FROM supplier")
def b05_gps(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.gps(F.col("s_acctbal") / 50, F.col("s_nationkey") * 10.0)["lat"].alias("lat"))


@query("SELECT user_id worker, round(10 * log10(avg(pow(10, value / 100))), 6) leq FROM events GROUP BY 1")
def b09_leq(spark, d):
    return samples(spark, d).groupBy("worker").agg(F.round(S.equivalent_level(F.col("value") / 10), 6).alias("leq"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'MISSING' WHEN event_type = 'signup' THEN 'NO_CONTACT' WHEN NOT value BETWEEN 5 AND 200 THEN 'OUT_OF_RANGE' END AS problem FROM events")
def b10_plausibility(spark, d):
    return samples(spark, d).select("event_id", S.plausibility(F.col("value"), 5, 200, F.col("event_type") == "signup").alias("problem"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 AND l_discount = 0 THEN 0.0::DOUBLE WHEN l_tax <> 0 THEN floor((l_discount - l_tax) / abs(l_tax) * 100.0 * 10 + 0.5) / 10 END change FROM lineitem")
def b15_percent_change(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.percent_change(F.col("l_discount"), F.col("l_tax")).alias("change"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'r#0000001') OR contains(lower(c_mktsegment), 'hold')")
def b17_search(spark, d):
    rows = table(spark, d, "customer")
    return rows.where(S.contains("R#0000001", F.col("c_name")) | S.contains("HOLD", F.col("c_mktsegment"))).select("c_custkey")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'EMERGENCY' WHEN value >= 30 THEN CASE WHEN value >= 60 THEN 'CRITICAL' ELSE 'WARNING' END WHEN event_type = 'signup' THEN 'UNCERTAIN' WHEN value IS NULL THEN 'UNKNOWN' ELSE 'SAFE' END AS state FROM events")
def b21_operational_state(spark, d):
    return samples(spark, d).select("event_id", S.operational_state(F.col("event_type") == "error", S.classified(F.col("value"), 30, 60), F.col("event_type") == "signup").alias("state"))


@query("SELECT c_custkey worker_id, CASE WHEN m IS NOT NULL THEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(m) <= 86400000000 END online FROM customer LEFT JOIN (SELECT user_id, max(ts) m FROM events GROUP BY 1) ON user_id = c_custkey")
def b23_online(spark, d):
    seen = samples(spark, d).groupBy("worker").agg(F.max("ts").cast("timestamp").alias("seen"))
    rows = workers(spark, d).join(seen, F.col("worker_id") == F.col("worker"), "left")
    return rows.select("worker_id", S.online(F.col("seen"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").cast("timestamp"), 86400).alias("online"))


@query("SELECT event_id, CAST(ts + INTERVAL 330 MINUTE - CASE WHEN hour(ts + INTERVAL 330 MINUTE) < 4 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS DATE) workday FROM events")
def b29_workday(spark, d):
    return samples(spark, d).select("event_id", S.workday(S.site_time(F.col("ts")), 4).alias("workday"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws(' + ', CASE WHEN l_tax > 0 THEN 'tax' END, CASE WHEN l_discount > 0 THEN 'discount' END), ''), '(none)') AS hazards FROM lineitem")
def b30_signature(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.signature({"tax": F.col("l_tax"), "discount": F.col("l_discount")}).alias("hazards"))


@query("SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 10")
def c01_names(spark, d):
    some = table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("worker_id"), F.col("c_name").alias("name"))
    return J.named(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("worker")), some).select("o_orderkey", "name")


@query(f"WITH {ALERTS}, l AS (SELECT worker, arg_max(kind, (ts, event_id)) latest FROM a GROUP BY 1) SELECT coalesce(latest, 'UNKNOWN') state, count(*) workers FROM customer LEFT JOIN l ON worker = c_custkey GROUP BY 1")
def c06_state_counts(spark, d):
    return J.state_counts(workers(spark, d), c09_latest_state(spark, d))


@query("SELECT user_id worker, CAST(ts AS DATE) AS day, min(event_id) event_id FROM events WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'click' AND s.user_id = events.user_id AND CAST(s.ts AS DATE) = CAST(events.ts AS DATE)) GROUP BY 1, 2")
def c10_unseen(spark, d):
    rows = samples(spark, d).withColumn("day", F.to_date("ts"))
    pick = lambda kind: rows.where(F.col("event_type") == kind).select("worker", "day", "event_id")
    return J.unseen(pick("view"), pick("click"), ["worker", "day"], "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND (round(l_quantity, 1), round(l_discount, 1), round(l_tax, 1)) IN (SELECT (round(l_quantity, 1), round(l_discount, 1), round(l_tax, 1)) FROM lineitem WHERE l_returnflag = 'R')")
def c15_leaks(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return J.leaks(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), ["l_quantity", "l_discount", "l_tax"], 1).select("l_orderkey", "l_linenumber")


@query("SELECT user_id worker, max(ts) ts, arg_max(event_id, (ts, event_id)) event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def c16_latest_wins(spark, d):
    rows = samples(spark, d).select("worker", "ts", "event_id", "value", "event_type")
    return J.latest_wins(rows.where("event_type = 'view'").drop("event_type"), rows.where("event_type = 'click'").drop("event_type"), "worker", ["ts", "event_id"])


@query("""WITH x AS (SELECT user_id worker, max({'size': abs(value - 30.0), 'd': value - 30.0}) m FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT worker, m.size AS size, m.d deviation FROM x ORDER BY 2 DESC, 1 LIMIT 10""")
def d09_top_deviation(spark, d):
    return A.largest_deviations(samples(spark, d).withColumn("deviation", F.col("value") - 30.0), top=10)


@query("SELECT event_type, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, round(avg(value), 6) mean, count(value) n FROM events GROUP BY 1, 2")
def d15_daily_averages(spark, d):
    return A.daily_means(samples(spark, d), "event_type", "value")


@query("SELECT count(*) n, count(DISTINCT user_id) AS keys, min(ts) from_ts, max(ts) to_ts, count(DISTINCT date_trunc('minute', ts)) AS minutes, count(*) FILTER (user_id IS NULL) null_worker, count(*) FILTER (ts IS NULL) null_ts, count(*) FILTER (value IS NULL) null_value FROM events")
def d22_inventory(spark, d):
    return P.inventory(samples(spark, d).select("worker", "ts", "value"), "worker", "ts")


@query("SELECT round(avg(CASE WHEN quality = 0 THEN toxic END), 6) of_given, round(avg(CASE WHEN toxic = 1 THEN CAST(quality = 0 AS INT) END), 6) given_of FROM labels")
def d29_conditional(spark, d):
    return P.conditional_shares(table(spark, d, "labels"), F.col("quality") == 0, F.col("toxic") == 1)


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) qp, round(corr(l_quantity, l_tax), 6) qt FROM lineitem")
def d30_correlation(spark, d):
    return P.correlations(table(spark, d, "lineitem"), {"qp": ("l_quantity", "l_extendedprice"), "qt": ("l_quantity", "l_tax")})


@query("SELECT event_type, count(value) n, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, min(value) low, max(value) high, round(quantile_cont(value, 0.1), 6) p10, round(quantile_cont(value, 0.9), 6) p90 FROM events GROUP BY 1")
def d31_describe(spark, d):
    return P.describe(samples(spark, d), "event_type", "value", [0.1, 0.9])


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') F, count(*) FILTER (l_linestatus = 'O') O FROM lineitem GROUP BY 1")
def d32_crosstab(spark, d):
    return P.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("SELECT t.x threshold, round(count(*) FILTER (least(value / 100, 1) >= t.x) / count(*), 6) coverage, round(count(*) FILTER (least(value / 100, 1) >= t.x AND event_type = 'view') / nullif(count(*) FILTER (least(value / 100, 1) >= t.x), 0), 6) accuracy FROM events, (SELECT CAST(unnest([0.5, 0.7, 0.9]) AS DOUBLE) x) t GROUP BY 1")
def d37_confidence(spark, d):
    rows = samples(spark, d).withColumn("confidence", F.least(F.col("value") / 100, F.lit(1.0)))
    return P.confidence_table(rows, "confidence", F.col("event_type") == "view", [0.5, 0.7, 0.9])


@query("WITH g AS (SELECT value v, count(*) FILTER (event_type = 'view') p, count(*) FILTER (event_type <> 'view') q FROM events WHERE value IS NOT NULL GROUP BY 1), h AS (SELECT *, coalesce(sum(q) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM g) SELECT round(sum(p * (b + q / 2)) / (sum(p) * sum(q)), 6) auc FROM h")
def d38_auc(spark, d):
    return P.auc(samples(spark, d), "value", F.col("event_type") == "view")


@query("""WITH t AS (SELECT quantile_cont(value, 0.2) threshold FROM events WHERE event_type = 'view') SELECT threshold, round(avg(CAST(event_type = 'view' AS INT)), 6) AS "precision" FROM events, t WHERE value >= threshold GROUP BY 1""")
def d38_precision(spark, d):
    return P.precision_at_recall(samples(spark, d), "value", F.col("event_type") == "view", 0.8)


@query("WITH u AS (UNPIVOT (SELECT c_custkey k, c_acctbal bal, CAST(c_nationkey AS DOUBLE) nation FROM customer) ON bal, nation INTO NAME feature VALUE a), w AS (UNPIVOT (SELECT s_suppkey k, s_acctbal bal, CAST(s_nationkey AS DOUBLE) nation FROM supplier) ON bal, nation INTO NAME feature VALUE b) SELECT feature, count(*) n, count(*) FILTER (abs(a - b) <= 5) matching, round(max(abs(a - b)), 6) largest, 0::BIGINT one_null FROM u JOIN w USING (k, feature) GROUP BY 1")
def d41_parity(spark, d):
    pick = lambda name, p: table(spark, d, name).select(F.col(f"{p}key").alias("k"), F.col(f"{p[0]}_acctbal").alias("bal"), F.col(f"{p[0]}_nationkey").alias("nation"))
    return J.parity(pick("customer", "c_cust"), pick("supplier", "s_supp"), "k", ["bal", "nation"], 5)


@query(f"WITH {SAMPLES}, x AS (SELECT *, CAST(us - lag(us) OVER o > 43200000000 AS INT) f, count(*) OVER (PARTITION BY worker ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) received FROM s WINDOW o AS (PARTITION BY worker ORDER BY us, event_id)), y AS (SELECT *, sum(coalesce(f, 0)) OVER (PARTITION BY worker ORDER BY us, event_id) run FROM x) SELECT event_id, received, CAST(row_number() OVER (PARTITION BY worker, run ORDER BY us, event_id) AS INT) since_gap FROM y")
def e10_receipts(spark, d):
    return W.receipts(_us(spark, d), 12 * HOUR).select("event_id", "received", "since_gap")


@query(f"WITH {SAMPLES}, x AS (SELECT *, value >= 30 act, lag(value >= 30) OVER o pa FROM s WINDOW o AS (PARTITION BY worker ORDER BY us, event_id)), y AS (SELECT *, CAST(sum(CASE WHEN act AND NOT coalesce(pa, false) THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY us, event_id) AS BIGINT) episode FROM x) SELECT worker, episode, count(*) n FROM y WHERE act GROUP BY 1, 2")
def e17_episodes(spark, d):
    return W.episodes(_us(spark, d), F.col("value") >= 30)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def g02_page(spark, d):
    return P.page(samples(spark, d).select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 3, 20)


@query("SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_acctbal >= (SELECT max(c_acctbal) FROM customer) - 50 - 1e-12 ORDER BY c_nationkey DESC, c_custkey LIMIT 1")
def g04_selection(spark, d):
    return P.picked(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey", "c_acctbal", ["c_nationkey"], 50.0)


def f10_gate(spark, d):
    """No SQL: late samples, sessions and pauses between alerts are recursive; tested by hand cases."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.unix_date(S.site_time(F.col("ts")).cast("date")).cast("long").alias("workday"), "value")
    return stateful.gate(rows, stateful.Limits(session_gap=24 * HOUR, refill_gap=8 * HOUR, cold_warmup=HOUR, least_samples=2, alert_after=HOUR))


def queries() -> dict:
    return {name: f for name, (f, _) in registry.found.items()} | {f.__name__: f for f in (f10_gate,)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registry.found.items() if sql is not None}


from wearstream.plans import dashboards, evaluation, live, periods, records, sites, timelines, views  # noqa: E402, F401  (their queries register themselves)
