"""What a task of the repeated passages' removal holds at a time."""

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
from tests.llm import brute  # noqa: E402
from wearstream.llm import common, substring_dedup  # noqa: E402

RNG = np.random.default_rng(4)


def prose(n):
    return [f"w{x}" for x in RNG.integers(0, 10**6, n)]


def test_a_task_sorts_its_suffixes_in_several_buckets(spark, monkeypatch):
    """The tables say that there are 4 million suffixes: each bucket of these, one row of hot windows, is an eighth at most."""
    shared = prose(300)
    rows = [(i, " ".join([*shared, *prose(20)])) for i in range(8)]
    tables, real = {}, substring_dedup.sampled

    def sampled(texts, k, one_in, *rest):
        longer, hot, _ = real(texts, k, 1, *rest)
        return longer, hot, 1 << 22

    def written(df, name):
        tables[name] = common.written(df, name)
        return tables[name]

    monkeypatch.setattr(substring_dedup, "sampled", sampled)
    monkeypatch.setattr(substring_dedup, "written", written)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["row"]["doc_id"]: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {i: v[:2] for i, v in brute.repeats_removed(rows).items()}
    assert tables["nodes"].where(f"part = {substring_dedup.HOT}").count() >= 8


def test_prefixes_that_many_batches_hold_a_few_times_are_lengthened(spark):
    """Each of 80 batches of the sample has the word 9 times, less than a 64th of the 640 suffixes that a group may hold; all have it 720 times."""
    rows = [(i, " ".join(w for _ in range(9) for w in ["the", *prose(3)]) + " " + " ".join(prose(12))) for i in range(80)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 80), "doc_id long, text string")
    word = substring_dedup.window_hashes(substring_dedup.hashes_of("the"), 1)
    for most, there in ((640, 1), (720, 0)):
        longer, _, total = substring_dedup.sampled(docs, 13, 1, most, 6, 1 << 16)
        assert total == 80 * 36 and len(longer.places(word)[0]) == there
