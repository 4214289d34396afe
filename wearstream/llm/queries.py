"""The queries that apply the operators to whole tables, and their SQL where it can express them."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearstream.llm import fast_sketch, jaccard_join, licenses, mixing, order_minhash, packing, periodic_runs, prefix_trie, quality_model, quality_rules, substring_dedup, tokens, toxicity
from wearstream.llm.common import words_of


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir))


def _split(column: str, parts: int, rest: int):
    return (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == rest).alias(column)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir), _table(spark, sf_dir, "labels"), train="crc32(cast(doc_id as string)) % 3 <> 1", threshold=0.7)
    return scored.select("doc_id", _split("held_out", 3, 1), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir)).drop("failed_rule")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.score_quality(_table(spark, sf_dir), _table(spark, sf_dir, "labels"), train="crc32(cast(doc_id as string)) % 5 <> 0", threshold=0.3)
    return scored.select("doc_id", _split("held_out", 5, 0), "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir).select("doc_id", "text"), k=13)
    return cut.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir).select("doc_id", "source")).drop("source")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(_table(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"), branch=True)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_sketch.near_duplicates(_table(spark, sf_dir), size=4, percent=80)


def looped(doc_id: int | None, text: str | None) -> list[bytes]:
    """A text's words; of one id in ten those from some place on repeat with a period, both given by the id's CRC."""
    words = words_of(text)
    h = crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * (1 + (n - a) // p))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(_table(spark, sf_dir), words=looped))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_quality_rules, op4_license_scan, op5_quality_classifier, op6_jaccard_join, op7_substring_dedup, op8_mixing, op9_order_minhash, op10_token_counts, op11_prefix_trie, op12_minhash_dedup, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_minhash_dedup": OP12_SQL}


OP11_SQL = """
WITH o AS (SELECT conv_id c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, own, xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: [CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 6 h FROM o),
s AS (SELECT h.c, coalesce(b.own[1:h], []) || h.own[h + 1:] s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100),
m AS (SELECT c, d, s[1:d] p, len(s) = d ended FROM (SELECT c, s, unnest(range(0, len(s) + 1)) d FROM s)),
n AS (SELECT p, d, min(c) conv_id, count(*) n, CASE WHEN d > 0 THEN length(p[d].t) ELSE 0 END w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '') e FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] p, d - 1 d, count(*) k FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(k, 0) k FROM n LEFT JOIN k USING (p, d)),
u AS (SELECT a.p, a.d, sum(CAST(b.k = 0 AS BIGINT)) leaves, sum((b.n - 1) * b.w) saved FROM f a JOIN f b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY 1, 2)
SELECT CAST(f.conv_id AS BIGINT) conv_id, f.d depth, CAST(q.conv_id AS BIGINT) parent_conv_id, f.n n_convs, f.k n_children, CAST(leaves AS BIGINT) n_leaves, CAST(saved AS BIGINT) saved_tokens, sha256(f.e) ends_sha256
FROM f JOIN u USING (p, d) LEFT JOIN n q ON q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]
"""

OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
e AS (SELECT a.doc_id a, b.doc_id b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id v, doc_id c FROM w UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v WHERE r.c < u.b)
SELECT CAST(v AS BIGINT) doc_id, coalesce(n, 0) n_shingles, CAST(min(c) AS BIGINT) component_id, v = min(c) kept FROM r LEFT JOIN n ON n.doc_id = v GROUP BY 1, 2, v
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
e AS (SELECT a.doc_id a, b.doc_id b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id v, doc_id c FROM w UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v WHERE r.c < u.b)
SELECT CAST(v AS BIGINT) doc_id, coalesce(n, 0) n_shingles, CAST(min(c) AS BIGINT) component_id FROM r LEFT JOIN n ON n.doc_id = v GROUP BY 1, 2
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) d FROM g GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + o p FROM (SELECT g.doc_id, i, unnest(range(13)) o FROM g JOIN f USING (k) WHERE f.d < g.doc_id)),
l AS (SELECT doc_id, list(p) ps FROM gone GROUP BY 1)
SELECT CAST(doc_id AS BIGINT) doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(len(ps), 0) AS BIGINT) n_removed,
sha256(array_to_string(list_filter(ws, lambda x, p: ps IS NULL OR NOT list_contains(ps, p)), ' ')) kept_sha256 FROM w LEFT JOIN l USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE c AS (SELECT source s, count(*) n, CAST(floor(sqrt(count(*))) AS BIGINT) w FROM documents GROUP BY 1),
q AS (SELECT s, n, w // (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) FROM c) part, row_number() OVER (ORDER BY s IS NOT NULL, s) k FROM c),
p AS (SELECT list(CAST(part AS BIGINT) ORDER BY k) ps, CAST(sum(part) AS BIGINT) total FROM q),
e(slot, nx, pick, i) AS (SELECT CAST(-1 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM p UNION ALL
  SELECT slot + 1, list_transform(nx, lambda x, j: x + CAST(j = next AS BIGINT)), next, nx[next] FROM (SELECT slot, nx, total, list_min(list_filter(list_transform(range(1, len(nx) + 1),
    lambda k: CASE WHEN nx[k] < ps[k] AND nx[k] * total // ps[k] <= slot + 1 THEN {'due': ((nx[k] + 1) * total + ps[k] - 1) // ps[k], 'k': k} END), lambda z: z IS NOT NULL)).k AS next FROM e, p WHERE slot + 1 < total)),
b AS (SELECT s, part, total, k, CAST(unnest(range((n + 63) // 64)) AS BIGINT) block FROM q, p),
t AS (SELECT s, block, block * total // part release, ((block + 1) * total + part - 1) // part due, row_number() OVER (ORDER BY block // part * total + slot) - 1 place FROM b JOIN e ON e.pick = b.k AND e.i = block % part),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 r FROM documents)
SELECT CAST(doc_id AS BIGINT) doc_id, source mix_source, r // 64 mix_block, CAST(release AS BIGINT) mix_release, CAST(due AS BIGINT) mix_due, place mix_slot, r % 64 mix_place FROM d JOIN t ON t.s IS NOT DISTINCT FROM source AND t.block = r // 64
"""

OP3_SQL = r"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) doc_id, coalesce(text, '') text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM t),
g AS (SELECT row_number() OVER () r, * FROM w),
s AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] k
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) i FROM g WHERE len(ws) >= 5)),
d AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) nxt FROM (SELECT *, count(*) OVER (PARTITION BY r, k) c FROM s) WHERE c > 1),
h AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) n FROM d GROUP BY r),
c AS (SELECT doc_id, text, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, CAST(coalesce(h.n, 0) AS BIGINT) n_repeat_words
      FROM g LEFT JOIN h USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 30 * n_words OR length(text) - length(replace(text, '!', '')) > 0.3 * n_words
         OR 100 * n_dup_lines > 40 * (length(text) - length(replace(text, chr(10), '')) + 1) OR word_chars > 25 * n_words
         OR 100 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 40 * word_chars) kept
FROM f
"""
