"""Stored records and rules on single readings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wearstream.functions import results as R
from wearstream.functions import scalars as S
from wearstream.operators import joins as J
from wearstream.operators import records as O
from wearstream.plans.registry import query
from wearstream.sources.tables import ALERTS_SQL, KIND_SQL, alerts, samples, table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@query("SELECT event_id, ts, value FROM events WHERE event_type IN ('view', 'click') AND user_id = 7")
def a06_find(spark, d):
    return O.find(samples(spark, d), {"event_type": ["view", "click"], "worker": 7}, ["event_id", "ts", "value"])


@query("""WITH b AS (SELECT user_id worker, list(event_id ORDER BY event_id) s FROM events GROUP BY 1)
SELECT worker, CASE WHEN len(s) > 80 THEN 'INVALID_BATCH' END problem, CASE WHEN len(s) <= 80 THEN CAST(unnest(range(CASE WHEN len(s) <= 80 THEN len(s) ELSE 1 END)) AS INT) END place,
CASE WHEN len(s) <= 80 THEN unnest(s[:CASE WHEN len(s) <= 80 THEN len(s) ELSE 1 END]) END event_id FROM b""")
def a07_batches(spark, d):
    batches = samples(spark, d).groupBy("worker").agg(F.array_sort(F.collect_list("event_id")).alias("samples"))
    return O.unpacked(batches, "samples", most=80).select("worker", "problem", "place", F.col("sample").alias("event_id"))


@query("SELECT user_id worker, arg_max(b, event_id).x baseline FROM (SELECT user_id, event_id, {'x': CASE WHEN event_type = 'signup' THEN NULL ELSE value END} b FROM events WHERE event_type IN ('signup', 'purchase')) GROUP BY 1")
def a11_baselines(spark, d):
    events = samples(spark, d).where("event_type in ('signup', 'purchase')").withColumn("baseline", F.when(F.col("event_type") != "signup", F.col("value")))
    return O.last_state(events, "worker", ["event_id"], ["baseline"])


@query("SELECT user_id worker, arg_max(event_type, (ts, event_id)) command, max(ts) ts FROM events GROUP BY 1")
def a22_commands(spark, d):
    return O.last_state(samples(spark, d), "worker", ["ts", "event_id"], ["event_type", "ts"]).withColumnRenamed("event_type", "command")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'R' ELSE o_orderstatus END o_orderstatus FROM orders")
def a23_resolved(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return O.updated(rows, (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), {"o_orderstatus": F.lit("R")}).drop("o_orderdate")


@query("SELECT l_orderkey, arg_min(l_suppkey, (l_shipdate, l_linenumber, l_suppkey)) ack_by, min(l_shipdate) ack_at FROM lineitem GROUP BY 1")
def a24_acknowledged(spark, d):
    acks = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("ack_by"), F.col("l_shipdate").alias("ack_at"), "l_linenumber")
    return O.first_write(acks, "l_orderkey", ["ack_at", "l_linenumber", "ack_by"], ["ack_by", "ack_at"])


@query("SELECT DISTINCT event_id, unnest(list_distinct(list_append((SELECT list(c_custkey) FROM customer WHERE c_acctbal > 9800), user_id))) recipient FROM events WHERE event_type = 'error'")
def a25_fan_out(spark, d):
    admins = table(spark, d, "customer").where("c_acctbal > 9800").select(F.col("c_custkey").alias("recipient"))
    return O.fanned_out(samples(spark, d).where("event_type = 'error'"), admins, "worker")


@query(f"SELECT event_id, ts FROM events WHERE ts >= {NOW} - INTERVAL 10 DAY")
def a26_retained(spark, d):
    return O.retained(samples(spark, d).select("event_id", "ts"), _now(), days=10)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(value AS VARCHAR) WHEN event_id % 3 = 0 THEN event_type END AS heart_rate, CASE WHEN event_id % 5 = 0 THEN event_type END AS gas FROM events")
def b01_aliases(spark, d):
    k = F.col("event_id")
    pairs = [("heart_rate", k % 2 == 0, F.col("value").cast("string")), ("heartRate", k % 3 == 0, F.col("event_type")), ("gas_ppm", k % 5 == 0, F.col("event_type"))]
    record = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.when(on, v).alias("value")) for n, on, v in pairs]), lambda e: e["value"].isNotNull()))
    return samples(spark, d).select("event_id", *R.aliased(record, {"heart_rate": ["heartRate"], "gas": ["gas_ppm"]}))


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN user_id END worker, CASE WHEN event_id % 4 < 3 THEN 'INVALID_PACKET' END problem FROM events")
def b04_readings(spark, d):
    k = F.col("event_id") % 4
    good = F.format_string('{"worker_id": %d, "timestamp": "%s"}', "worker", F.col("ts").cast("string"))
    text = F.when(k == 0, '{"worker_id": 1, "timesta').when(k == 1, '{"timestamp": "2024-01-01"}').when(k == 2, F.format_string('{"worker_id": %d}', "worker")).otherwise(good)
    parsed = samples(spark, d).select("event_id", k.alias("k"), R.parsed_reading(text, "worker_id long, timestamp string").alias("p"))
    return parsed.select("event_id", F.when(F.col("k") > 1, F.col("p.r.worker_id")).alias("worker"), "p.problem")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(l_discount / l_tax, 6) END ratio FROM lineitem")
def b07_gas_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.gas_ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"))


@query("SELECT event_id FROM events WHERE event_id % 3 > 0 AND event_id % 7 > 0")
def b13_numbers(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "none").when(F.col("event_id") % 7 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return samples(spark, d).where(R.is_number(text)).select("event_id")


@query("SELECT user_id worker, round(avg(value) FILTER (event_type = 'view'), 6) mean, round(quantile_cont(value, 0.5) FILTER (event_type = 'view'), 6) median FROM events GROUP BY 1")
def b16_mean_median(spark, d):
    lists = samples(spark, d).groupBy("worker").agg(F.collect_list(F.when(F.col("event_type") == "view", F.col("value"))).alias("v"))
    return lists.select("worker", F.round(R.mean_of(F.col("v")), 6).alias("mean"), F.round(R.median_of(F.col("v")), 6).alias("median"))


@query(f"WITH {ALERTS_SQL} SELECT event_id, kind FROM a WHERE worker = 12 AND kind = 'CRITICAL' AND ts >= {NOW} - INTERVAL 20 DAY")
def b18_filtered(spark, d):
    rows = O.filtered(alerts(spark, d), owner=("worker", 12), since=_now() - F.expr("interval '20' day"), kind="CRITICAL", event_id=None)
    return rows.select("event_id", "kind")


@query(f"""WITH {ALERTS_SQL}, x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PACKET_LOSS' WHEN 1 THEN 'ODD' WHEN 2 THEN 'UNSTABLE_HR' END r, kind, lag(kind) OVER (PARTITION BY worker ORDER BY ts, event_id) b FROM a)
SELECT event_id, CASE r WHEN 'PACKET_LOSS' THEN 'too few samples arrived lately' WHEN 'UNSTABLE_HR' THEN 'the heart rate jumps about' ELSE coalesce(r, 'unknown reason') END reason,
CASE WHEN b IS NULL THEN 'Risk state: ' || kind ELSE 'Risk changed: ' || b || ' → ' || kind END AS label FROM x""")
def b19_labels(spark, d):
    k = F.col("event_id") % 4
    before = F.lag("kind").over(Window.partitionBy("worker").orderBy("ts", "event_id"))
    code = F.when(k == 0, "PACKET_LOSS").when(k == 1, "ODD").when(k == 2, "UNSTABLE_HR")
    return alerts(spark, d).select("event_id", R.reason_text(code).alias("reason"), R.transition_label(before, F.col("kind")).alias("label"))


@query(f"SELECT event_id, CASE WHEN k IN ('WARNING', 'CRITICAL') THEN k WHEN event_id % 5 = 0 OR k NOT IN ('SAFE') THEN 'UNCERTAIN' ELSE k END led FROM (SELECT event_id, {KIND_SQL} k FROM events)")
def b22_lamp(spark, d):
    return alerts(spark, d).select("event_id", R.led_state(F.col("kind"), F.col("event_id") % 5 == 0).alias("led"))


@query("SELECT event_id, CASE WHEN value / 100 < 0.7 THEN 'UNCERTAIN' ELSE CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' ELSE 'SAFE' END END AS state FROM events")
def b24_confident(spark, d):
    return samples(spark, d).select("event_id", S.confident(S.classified(F.col("value"), 30, 60), F.col("value") / 100).alias("state"))


@query("""WITH x AS (SELECT event_id, CASE WHEN value >= 60 THEN 2 WHEN value >= 30 THEN 1 ELSE 0 END a, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END b FROM events)
SELECT event_id, ['SAFE', 'WARNING', 'CRITICAL'][greatest(a, coalesce(b, 0)) + 1] AS state FROM x""")
def b25_backstop(spark, d):
    k = F.col("event_id") % 4
    return samples(spark, d).select("event_id", R.raised(S.classified(F.col("value"), 30, 60), F.when(k == 0, "CRITICAL").when(k == 1, "WARNING").when(k == 2, "SAFE")).alias("state"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'UNCERTAIN' WHEN event_id % 11 > 0 AND event_id % 5 > 0 THEN 'SAFE' END AS state, CASE WHEN event_id % 7 > 0 AND event_id % 11 > 0 AND event_id % 5 > 0 THEN value / 1000 END confidence,
CASE WHEN event_id % 7 = 0 THEN 'UNCERTAIN' WHEN event_id % 11 > 0 AND event_id % 5 > 0 THEN CASE WHEN event_id % 3 = 0 THEN 'IMPUTED' ELSE 'VALID' END END quality, CASE WHEN event_id % 7 = 0 THEN 'UNSPECIFIED' END reason FROM events""")
def b26_normalised(spark, d):
    k = F.col("event_id")
    answer = {
        "cls": F.when(k % 7 == 0, "uncertain").otherwise("Safe"), "ready": k % 11 > 0, "model": F.when(k % 5 > 0, "m").otherwise("other"), "features": F.lit("f"), "reason": F.lit(None).cast("string"),
        "quality": F.when(k % 3 == 0, "IMPUTED"), "probabilities": F.create_map(F.lit("Safe"), F.col("value") / 1000, F.lit("odd"), F.lit(0.5)),
    }
    return samples(spark, d).select("event_id", R.normalised(answer, "m", "f").alias("r")).select("event_id", "r.*")


@query("SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'a' END, CASE WHEN value < 20 THEN 'b' END, CASE WHEN event_id % 6 = 0 THEN 'c' END) AS missing FROM events")
def b27_missing(spark, d):
    k = F.col("event_id")
    of = {"a": F.when(k % 2 > 0, 1.0), "b": F.when(F.col("value") >= 20, F.col("value")), "c": F.when(k % 6 > 0, 0.0).otherwise(float("nan"))}
    return samples(spark, d).select("event_id", F.concat_ws(",", R.missing(of)).alias("missing"))


@query("SELECT n_nationkey, CASE WHEN r = 0 THEN 'UNSAFE' WHEN r < 0.25 THEN 'POOR' WHEN r < 0.5 THEN 'LIMITED' ELSE '' END flag FROM (SELECT n_nationkey, (n_nationkey % 9) / 10 r FROM nation)")
def b31_recall_flags(spark, d):
    return table(spark, d, "nation").select("n_nationkey", R.recall_flag((F.col("n_nationkey") % 9) / 10).alias("flag"))


@query("SELECT 'Customer#' || lpad(CAST(max(CAST(substr(c_name, 10) AS BIGINT)) + 1 AS VARCHAR), 9, '0') next_id FROM customer")
def b33_next_id(spark, d):
    return O.next_id(table(spark, d, "customer"), "c_name", "Customer#", 9)


@query("SELECT c_custkey, c_name FROM customer")
def b34_public(spark, d):
    return O.public(table(spark, d, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment", "no_such_column"])


@query("""SELECT event_id, 'value' factor, CASE WHEN value >= 60 THEN 'CRITICAL' ELSE 'WARNING' END severity, NULL::BOOLEAN attention FROM events WHERE value >= 30
UNION ALL SELECT event_id, 'heart_rate', 'INFO', abs((value - 30) / 30 * 100) >= 20 FROM events""")
def b35_factors(spark, d):
    v = F.col("value")
    level = S.classified(v, 30, 60)
    environment = F.when(level != "SAFE", F.struct(F.lit("value").alias("factor"), level.alias("severity"), F.lit(None).cast("boolean").alias("attention")))
    heart = F.struct(F.lit("heart_rate").alias("factor"), F.lit("INFO").alias("severity"), (F.abs(S.deviation_percent(v, F.lit(30.0))) >= 20).alias("attention"))
    factors = F.filter(F.array(environment, heart), lambda f: f.isNotNull())
    return samples(spark, d).select("event_id", F.explode(factors).alias("f")).select("event_id", "f.*")


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'FAULT' WHEN value < 2 OR value > 120 THEN 'CRITICAL' WHEN value < 5 OR value > 60 THEN 'WARNING' END AS level FROM events")
def b36_bands(spark, d):
    x = F.when(F.col("event_type") != "signup", F.col("value"))
    return samples(spark, d).select("event_id", R.outside(x, {"CRITICAL": (2, 120), "WARNING": (5, 60)}).alias("level"))


@query("SELECT event_type, user_id worker, arg_max(event_id, ({'p': floor(value / 50), 'i': -event_id})) event_id FROM events GROUP BY 1, 2")
def h04_dedupe_priority(spark, d):
    rows = samples(spark, d).select("event_type", "worker", "event_id", "value")
    return O.deduplicated(rows, ["event_type", "worker"], F.floor(F.col("value") / 50), ["event_id"]).drop("value")


@query("SELECT c_custkey k, c_nationkey n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def h01_concatenated(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return J.concatenated([a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"))])


@query("SELECT l_quantity, l_discount, l_tax, count(*) times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def h03_duplicates(spark, d):
    return O.duplicates(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax"))


@query("SELECT 'nation' field, CAST(c_nationkey AS VARCHAR) AS value, count(DISTINCT c_custkey) AS keys FROM customer GROUP BY 2 HAVING count(DISTINCT c_custkey) > 1")
def l10_conflicts(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    return O.conflicts(rows, "c_custkey", ["nation", "name"])


@query(f"""WITH x AS (SELECT event_id, CASE WHEN value >= 60 THEN 2 WHEN value >= 30 THEN 1 WHEN event_id % 3 > 0 THEN 0 ELSE -1 END r, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE -1 END f, event_type = 'error' e, event_id % 2 = 0 u FROM events)
SELECT event_id, CASE WHEN e THEN 'EMERGENCY' WHEN greatest(r, f) >= 0 THEN ['SAFE', 'WARNING', 'CRITICAL'][greatest(r, f) + 1] WHEN u THEN 'UNCERTAIN' ELSE 'UNKNOWN' END AS state FROM x""")
def k01_overall(spark, d):
    k, v = F.col("event_id"), F.col("value")
    risk = F.when((v >= 30) | (k % 3 > 0), S.classified(v, 30, 60))
    factor = F.when(k % 5 == 0, "CRITICAL").when(k % 5 == 1, "WARNING").otherwise("SAFE")
    return samples(spark, d).select("event_id", R.overall_state(F.col("event_type") == "error", risk, F.array(factor, F.lit("INFO")), k % 2 == 0).alias("state"))


@query(f"WITH {ALERTS_SQL} SELECT event_id, CASE WHEN kind = 'EMERGENCY' AND worker % 10 = 0 THEN true WHEN kind = 'CRITICAL' THEN worker % 3 > 0 WHEN kind = 'EMERGENCY' THEN worker % 2 = 0 ELSE false END AS toast FROM a")
def k05_toasts(spark, d):
    w = F.col("worker")
    role = F.when(w % 10 == 0, "ADMIN").otherwise("WORKER")
    return alerts(spark, d).select("event_id", R.wanted_toast(F.col("kind"), role, {"CRITICAL": w % 3 > 0, "EMERGENCY": w % 2 == 0}).alias("toast"))
