"""The mixture's order through the files between the stages."""

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from wearstream.llm.common import written  # noqa: E402


def test_sequences_follow_the_mixture_over_many_files(spark):
    # nine rows of "hot" to one of "cold": square roots give three to one until "cold" ends with 4 / 10 of the rows
    docs = spark.range(20000).selectExpr("id doc_id", "concat('word ', repeat('some text ', cast(20 + id % 7 as int))) text", "if(id % 10 = 0, 'cold', 'hot') source").repartition(7)
    mixed = written(corpus_pipeline.mixture(spark, docs, "").repartition(6), "stage-mixture")
    assert len(mixed.inputFiles()) == 6
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = corpus_pipeline.packed(spark, mixed, "").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({p.sequence_id >> 32 for p in pieces}) > 1
    assert {p.doc_id for p in pieces} == set(range(20000))
    at, cold, tokens = 0, 0, 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        tokens += p.length
        cold += p.length * (p.doc_id % 10 == 0)
        at += 1
        if 1500 < at < 7000:  # before "cold" ends at 8000
            assert abs(cold / tokens - 0.25) < 0.05, at
    assert cold / tokens < 0.12
