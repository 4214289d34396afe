"""Quality rules as a short-circuit cascade, in SQL functions alone."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearstream.llm.common import checkpointed

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, k: int) -> Column:
    """Words within windows of k words that an array of words has twice or more."""
    starts = F.sequence(F.lit(0), F.size(words) - k)
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(k)]).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
    covered = F.aggregate(
        let(F.array_sort(hashed), twice), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(k), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"].cast("long")
    )
    return F.when(F.size(words) >= k, covered).otherwise(F.lit(0).cast("long"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base counts of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    return base.select(
        "doc_id", "text",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w, 5).alias("r"))).alias("w"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "text", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))


#: Rules beside the base ones: name -> SQL condition that rejects, over the counts and the text.
RULES = {
    "symbols": "100 * n_symbols > 30 * n_words",
    "shouting": r"length(text) - length(replace(text, '!', '')) > 0.3 * n_words",
    "repeated_lines": r"100 * n_dup_lines > 40 * (length(text) - length(replace(text, '\n', '')) + 1)",
    "long_words": "word_chars > 25 * n_words",
    "few_letters": r"100 * length(regexp_replace(text, '[^\\p{L}]', '')) < 40 * word_chars",
}
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


#: Seconds that a rule over counts alone is charged, and texts that are measured at most.
FREE = 1e-4
SAMPLE_ROWS = 2000


def measured(docs: DataFrame, rules: dict[str, str], sample_rows: int) -> tuple[dict[str, float], list[tuple[frozenset, int]]]:
    """Each rule's own seconds on a sample of at most sample_rows texts, and how many of them each set of rules rejects.

    The counts are computed once and kept, as every row's are; a rule that reads no text beyond them is charged next to
    nothing, one that does the faster of two runs over the kept rows, less what an empty rule takes. The verdicts don't
    depend on the sample.
    """
    few = checkpointed(docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).limit(sample_rows))  # no counts for more
    sample = checkpointed(counted(few).where(f"not ({BASE})"))

    def seconds(rule: str) -> float:
        began = time.perf_counter()
        sample.where(rule).agg(F.count("*")).first()
        return time.perf_counter() - began

    dear = [name for name, rule in rules.items() if "text" in rule]
    idle = min(seconds("text is null") for _ in range(3))  # the first also compiles and warms up
    cost = {name: max(min(seconds(rules[name]) for _ in range(2)) - idle, FREE) if name in dear else FREE for name in rules}
    flags = F.concat_ws(",", *[F.when(F.expr(rule), name) for name, rule in rules.items()]).alias("hit")
    hits = sample.groupBy(flags).count().collect()  # at most a row for each set of rules
    return cost, [(frozenset(x for x in r["hit"].split(",") if x), r["count"]) for r in hits]


def cascade(cost: dict[str, float], hits: list[tuple[frozenset, int]]) -> list[str]:
    """The rules one by one: next the one that rejects most of what is left per second; ties by cost, then as given."""
    order: list[str] = []
    while len(order) < len(cost):
        left = [(h, n) for h, n in hits if not h & set(order)]
        gain = {name: sum(n for h, n in left if name in h) for name in cost if name not in order}
        order.append(min(gain, key=lambda name: (-gain[name] / cost[name], cost[name])))
    return order


def quality_rules(docs: DataFrame, *, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and failed_rule (base, or the first rule as given that rejects).

    kept is false if base_failed or any rule rejects. The counts are results and computed for every row; beyond them,
    rules run in the cascade's order and stop at the first that rejects, so a rejected row skips the later rules' passes
    over its text. failed_rule is looked up for rejected rows alone and doesn't
    depend on the order. A null text is empty and fails as too short; a null doc_id is kept, repeated rows give a row
    each, an empty table gives no rows and other columns aren't read. Texts are whole and nothing is shuffled.
    """
    counts = counted(docs)
    rejected = F.when(F.expr(BASE), True)
    for name in cascade(*measured(docs, rules, sample_rows)):
        rejected = rejected.when(F.expr(rules[name]), True)
    first = F.when(F.expr(BASE), "base")
    for name, rule in rules.items():
        first = first.when(F.expr(rule), name)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counts.select(*columns, F.expr(BASE).alias("base_failed"), (~rejected.otherwise(False)).alias("kept"), F.when(rejected, first).alias("failed_rule"))
