"""Evaluation and preparation of classifiers: labels stand for verdicts, line items for features, events for samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearstream.functions import scalars as S
from wearstream.models import training as M
from wearstream.operators import aggregates as A
from wearstream.operators import evaluation as E
from wearstream.operators import profiles as P
from wearstream.plans.registry import query
from wearstream.sources.tables import samples, table

LEVEL = "CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'WARNING' ELSE 'SAFE' END"
SAID = "CASE WHEN value + event_id % 17 >= 60 THEN 'CRITICAL' WHEN value - event_id % 13 >= 30 THEN 'WARNING' ELSE 'SAFE' END"
JUDGED = f"j AS (SELECT event_id, user_id, value, {LEVEL} truth, {SAID} said, event_type algo, 'EXP' || (event_id % 3) experiment FROM events)"
RESULTS = "r AS (SELECT 'EXP' || (l_orderkey % 3) experiment, l_returnflag || l_linestatus model, round(avg(l_discount), 6) accuracy, round(avg(l_tax), 6) macro_f1, round(avg(l_quantity), 6) q FROM lineitem GROUP BY ALL)"


def _judged(spark, d):
    v, k = F.col("value"), F.col("event_id")
    said = F.when(v + k % 17 >= 60, "CRITICAL").when(v - k % 13 >= 30, "WARNING").otherwise("SAFE")
    return samples(spark, d).withColumns({"truth": S.classified(v, 30, 60), "said": said, "algo": F.col("event_type"), "experiment": F.concat(F.lit("EXP"), (k % 3).cast("string"))})


def _results(spark, d):
    rows = table(spark, d, "lineitem").withColumn("experiment", F.concat(F.lit("EXP"), (F.col("l_orderkey") % 3).cast("string"))).withColumn("model", F.concat("l_returnflag", "l_linestatus"))
    return rows.groupBy("experiment", "model").agg(F.round(F.avg("l_discount"), 6).alias("accuracy"), F.round(F.avg("l_tax"), 6).alias("macro_f1"), F.round(F.avg("l_quantity"), 6).alias("q"))


@query(f"""WITH {JUDGED}, m AS (SELECT truth, said, count(*) n FROM j GROUP BY 1, 2), c AS (SELECT k, coalesce(sum(n) FILTER (truth = k), 0) s, coalesce(sum(n) FILTER (said = k), 0) p, coalesce(sum(n) FILTER (truth = k AND said = k), 0) h FROM m, (SELECT unnest(['SAFE', 'WARNING', 'CRITICAL']) k) GROUP BY 1),
f AS (SELECT *, coalesce(h / nullif(p, 0), 0) pr, coalesce(h / nullif(s, 0), 0) re FROM c), g AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) f1 FROM f)
SELECT CAST(sum(s) AS BIGINT) n, round(sum(h) / sum(s), 6) accuracy, round(avg(re) FILTER (s > 0), 6) balanced_accuracy, round(avg(pr) FILTER (s > 0), 6) macro_precision, round(avg(re) FILTER (s > 0), 6) macro_recall, round(avg(f1) FILTER (s > 0), 6) macro_f1,
round(sum(s * f1) / sum(s), 6) weighted_f1, round(max(re) FILTER (k = 'CRITICAL'), 6) critical_recall, round(1 - max(re) FILTER (k = 'CRITICAL'), 6) critical_fnr,
round((SELECT coalesce(sum(n), 0) FROM m WHERE truth = 'CRITICAL' AND said = 'SAFE') / max(s) FILTER (k = 'CRITICAL'), 6) critical_to_safe FROM g""")
def d34_summary(spark, d):
    matrix = _judged(spark, d).groupBy("truth", "said").agg(F.count("*").alias("n"))
    return E.summary(matrix, "truth", "said", ["SAFE", "WARNING", "CRITICAL"], "CRITICAL", "SAFE")


@query(f"WITH {RESULTS} SELECT experiment, round(avg(accuracy), 6) accuracy, round(avg(macro_f1), 6) macro_f1 FROM r GROUP BY 1")
def d35_means(spark, d):
    return E.means(_results(spark, d), "experiment", ["accuracy", "macro_f1"])


@query(f"WITH {RESULTS}, b AS (SELECT model, arg_min(experiment, (-accuracy, experiment)) experiment FROM r GROUP BY 1) SELECT experiment, count(*) wins FROM b GROUP BY 1")
def d35_wins(spark, d):
    return E.wins(_results(spark, d), "experiment", "model", "accuracy")


@query(f"WITH {JUDGED} SELECT experiment, algo, count(*) critical, count(*) FILTER (said = 'CRITICAL') caught, count(*) FILTER (said = 'WARNING') to_warning, count(*) FILTER (said = 'SAFE') to_safe, round(avg(value / 500), 6) mean_probability FROM j WHERE truth = 'CRITICAL' GROUP BY 1, 2")
def d36_outcomes(spark, d):
    return E.critical_outcomes(_judged(spark, d), ["experiment", "algo"], F.col("truth"), F.col("said"), F.col("value") / 500)


@query("SELECT l_returnflag, round(avg(CAST(l_tax > 0.04 AS INT)), 6) tax, round(avg(CAST(l_discount > 0.05 AS INT)), 6) discount FROM lineitem GROUP BY 1")
def d28_hazard_shares(spark, d):
    return E.shares(table(spark, d, "lineitem"), "l_returnflag", {"tax": F.col("l_tax") > 0.04, "discount": F.col("l_discount") > 0.05})


@query("""WITH m AS (SELECT avg(value) m1, stddev_pop(value) d1, avg(event_id % 101) m2, stddev_pop(event_id % 101) d2 FROM events), z AS (SELECT event_id, event_type, (value - m1) / d1 a, (event_id % 101 - m2) / d2 b FROM events, m),
c AS (SELECT event_type, avg(a) a, avg(b) b FROM z GROUP BY 1), x AS (SELECT z.event_id, c.event_type, round(pow(z.a - c.a, 2) + pow(z.b - c.b, 2), 9) d FROM z, c WHERE z.event_type = 'error') SELECT event_id, arg_min(event_type, (d, event_type)) nearest FROM x GROUP BY 1""")
def d40_nearest(spark, d):
    rows = samples(spark, d).withColumn("k", F.col("event_id") % 101)
    return E.nearest_centroid(rows, rows.where("event_type = 'error'").select("event_id", "value", "k"), "event_type", ["value", "k"]).select("event_id", "nearest")


@query("""WITH u AS (UNPIVOT (SELECT l_linenumber, CAST(l_quantity AS DOUBLE) l_quantity, CAST(l_discount AS DOUBLE) l_discount, CAST(l_tax AS DOUBLE) l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME channel VALUE v),
s AS (SELECT channel, round((avg(v) FILTER (l_linenumber = 1) - avg(v) FILTER (l_linenumber = 2)) / nullif(stddev_samp(v) FILTER (l_linenumber <> 1), 0), 6) smd FROM u GROUP BY 1) SELECT * FROM s ORDER BY abs(smd) DESC, channel LIMIT 2""")
def d27_largest(spark, d):
    line = F.col("l_linenumber")
    return A.largest_differences(A.mean_difference(table(spark, d, "lineitem"), line == 1, line == 2, line != 1, ["l_quantity", "l_discount", "l_tax"]), 2)


@query("SELECT user_id worker, count(*) n, count(*) - count(DISTINCT (event_type, floor(value))) repeats FROM events GROUP BY 1")
def d22_repeats(spark, d):
    rows = samples(spark, d).select("worker", "event_type", F.floor("value").alias("v"))
    once = rows.groupBy("worker", "event_type", "v").agg(F.count("*").alias("n"))
    return once.groupBy("worker").agg(F.sum("n").alias("n"), (F.sum("n") - F.count("*")).alias("repeats"))


@query("""WITH u AS (UNPIVOT (SELECT l_returnflag = 'R' AS r, l_quantity + CASE WHEN l_returnflag = 'R' THEN 40 ELSE 0 END quantity, l_discount FROM lineitem) ON quantity, l_discount INTO NAME name VALUE v),
g AS (SELECT name, round(quantile_cont(v, 0.5) FILTER (r), 6) median, round(quantile_cont(v, 0.1) FILTER (NOT r), 6) low, round(quantile_cont(v, 0.9) FILTER (NOT r), 6) high FROM u GROUP BY 1) SELECT * FROM g WHERE median < low OR median > high""")
def l19_outside_range(spark, d):
    rows = table(spark, d, "lineitem").withColumn("quantity", F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 40).otherwise(0))
    return E.outside_range(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), ["quantity", "l_discount"])


@query(f"WITH {JUDGED} SELECT round(avg(CAST(truth = said AS INT)), 6) agreement FROM j")
def l18_agreement(spark, d):
    return E.agreement(_judged(spark, d), "truth", "said")


@query(f"WITH {RESULTS}, o AS (SELECT accuracy a, macro_f1 f FROM r WHERE experiment = 'EXP1' AND model = 'AF') SELECT count(*) FILTER (accuracy > a) + 1 accuracy_rank, round(max(accuracy) - any_value(a), 6) accuracy_gap, count(*) FILTER (macro_f1 > f) + 1 macro_f1_rank, round(max(macro_f1) - any_value(f), 6) macro_f1_gap FROM r, o")
def l18_standing(spark, d):
    return E.standing(_results(spark, d), (F.col("experiment") == "EXP1") & (F.col("model") == "AF"), ["accuracy", "macro_f1"])


@query("SELECT coalesce(CASE WHEN event_id % 4 > 0 THEN event_type END, '(none)') AS value, count(*) n FROM events GROUP BY 1")
def l20_rule_counts(spark, d):
    return E.value_counts(samples(spark, d).withColumn("rule", F.when(F.col("event_id") % 4 > 0, F.col("event_type"))), "rule")


@query("""WITH p AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) a, avg(value) FILTER (event_id % 2 = 1) b FROM events GROUP BY 1), k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 rb FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT round(corr(ra, rb), 6) spearman, (SELECT round(avg(abs(a - b)), 6) FROM p) mean_change FROM k""")
def l21_rank_shift(spark, d):
    even = F.col("event_id") % 2 == 0
    per = samples(spark, d).groupBy("worker").agg(F.avg(F.when(even, F.col("value"))).alias("a"), F.avg(F.when(~even, F.col("value"))).alias("b"))
    return E.rank_shift(per, "a", "b")


@query("SELECT n_nationkey, n_regionkey % 2 = 0 same FROM nation")
def l17_same_settings(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    a = rows.select("n_nationkey", F.format_string('{"c": %d, "k": "x"}', "n_regionkey").alias("params"))
    b = rows.select("n_nationkey", F.format_string('{"k": "x",  "c": %d}', F.col("n_regionkey") + F.col("n_regionkey") % 2).alias("params"))
    return E.same_settings(a, b, ["n_nationkey"], "params", "c int, k string")


@query("SELECT worker, event_id, place FROM (SELECT user_id worker, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value >= 60 THEN 3 WHEN value >= 30 THEN 2 ELSE 1 END DESC, event_id) place FROM events) WHERE place <= 4")
def g03_first_factors(spark, d):
    rank = F.when(F.col("value") >= 60, 3).when(F.col("value") >= 30, 2).otherwise(1)
    return E.first_by_severity(samples(spark, d), "worker", rank, "event_id", 4).select("worker", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT max(CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT)) largest FROM supplier")
def g06_largest_number(spark, d):
    return table(spark, d, "supplier").agg(F.max(F.regexp_extract("s_name", r"([0-9]+)$", 1).cast("long")).alias("largest"))


@query("SELECT count(*) total, CAST(ceil(count(*) / 20.0) AS BIGINT) pages FROM events WHERE event_type = 'view'")
def g02_page_count(spark, d):
    return P.page_count(samples(spark, d).where("event_type = 'view'"), 20)


@query("""WITH t AS (SELECT event_id, event_id % 3 > 0 train, CASE WHEN event_id % 7 > 0 THEN value END v, event_id % 50 k FROM events), q AS (SELECT quantile_cont(v, 0.5) mv FROM t WHERE train), f AS (SELECT event_id, train, coalesce(v, mv) v, k FROM t, q),
m AS (SELECT avg(v) a, stddev_pop(v) b, avg(k) c, stddev_pop(k) d FROM f WHERE train) SELECT event_id, round((v - a) / b, 6) v, round((k - c) / d, 6) k FROM f, m""")
def j02_standardised(spark, d):
    k = F.col("event_id")
    rows = samples(spark, d).select("event_id", (k % 3 > 0).alias("train"), F.when(k % 7 > 0, F.col("value")).alias("v"), (k % 50).cast("double").alias("k"))
    out = M.standardised(rows.where("train"), rows, ["v", "k"])
    return out.select("event_id", F.round("v", 6).alias("v"), F.round("k", 6).alias("k"))


@query("""WITH c AS (SELECT event_type k, count(*) n FROM events GROUP BY 1), w AS (SELECT *, sum(n) OVER () / (count(*) OVER () * n) * CASE k WHEN 'error' THEN 2 WHEN 'click' THEN 0.75 ELSE 1 END raw FROM c),
x AS (SELECT k, raw / (sum(raw * n) OVER () / sum(n) OVER ()) weight FROM w) SELECT event_id, round(weight, 6) weight FROM events JOIN x ON k = event_type""")
def j03_weights(spark, d):
    return M.with_weights(samples(spark, d), "event_type", {"error": 2, "click": 0.75}).select("event_id", F.round("weight", 6).alias("weight"))


@query("""WITH i AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM events), e AS (SELECT *, unnest([0, 1, 2, 3, 4]) k FROM i),
b AS (SELECT *, i >= k * n // 5 AND i < (k + 1) * n // 5 inside, i >= k * n // 5 - 3 AND i < (k + 1) * n // 5 + 3 near FROM e)
SELECT event_id, max(k) FILTER (inside) block, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (near AND NOT inside), '') purged_from FROM b GROUP BY 1""")
def j05_blocks(spark, d):
    rows = M.with_blocks(samples(spark, d), ["event_id"], 5, 3)
    return rows.select("event_id", "block", F.concat_ws(",", F.transform("purged_from", lambda x: x.cast("string"))).alias("purged_from"))


@query("""WITH i AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 i FROM events), b AS (SELECT *, i // 5 b, i % 5 r FROM i), m AS (SELECT *, max(b) OVER (PARTITION BY user_id) z FROM b)
SELECT event_id, CASE WHEN b % 3 = 1 THEN 'stop' WHEN (r < 2 AND b > 0 AND (b - 1) % 3 = 1) OR (r >= 3 AND (b + 1) % 3 = 1 AND b < z) THEN 'purged' ELSE 'fit' END part FROM m""")
def j06_stopping_split(spark, d):
    return M.with_stopping_split(samples(spark, d), ["event_id"], block=5, every=3, purge=2).select("event_id", "part")


@query("""WITH h AS (SELECT event_id, event_type, (event_id * 2654435761 + 42 * 40503) % 4294967296 h FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) k, count(*) OVER (PARTITION BY event_type) n FROM h)
SELECT event_id, k <= floor(n * 0.2::DOUBLE + 0.5) test FROM r""")
def j12_split(spark, d):
    return M.split(samples(spark, d), "event_type", "event_id", 42).select("event_id", "test")
