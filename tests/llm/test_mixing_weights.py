"""The mixture against its target weights: over many periods, with many sources, and with awkward rows and names."""

from fractions import Fraction

import pytest

pytest.importorskip("wearstream.llm")
from wearstream.llm import mixing  # noqa: E402


def worst_deviation(rows, weights, until):
    """The largest distance, over slots before until, of a source's blocks from its exact share."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    total = sum(exact.values())
    part, done, worst = {s: w / total for s, w in exact.items()}, dict.fromkeys(weights, 0), 0
    for at, (slot, s) in enumerate(sorted(rows)[:until]):
        assert slot == at
        # the extremes are just before and after a source's own turns
        worst = max(worst, slot * part[s] - done[s], done[s] + 1 - (slot + 1) * part[s])
        done[s] += 1
    return max([worst, *(abs(done[s] - until * part[s]) for s in weights)])


@pytest.mark.parametrize("weights", [{"a": 2, "b": 1}, {"a": 0.5, "b": 0.2, "c": 0.15, "d": 0.1, "e": 0.05}, {"hot": 5000} | {f"s{i}": 1 + i % 3 for i in range(2000)}, {"a": 1}])
def test_turns_stay_within_a_block_of_the_weights(weights):
    whole = mixing.whole_weights(weights)
    period = list(mixing.turns(whole))
    rows = [(k * len(period) + at, s) for k in range(-(-10000 // len(period))) for at, (s, _) in enumerate(period)]
    assert worst_deviation(rows, weights, 10000) < 1
    for s, n in whole.items():
        assert [i for t, i in period if t == s] == list(range(n))


def test_mix_sources_follows_weights(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "if(id % 3 < 2, 'a', 'b') source")
    rows = mixing.mix_sources(docs, weights={"a": 2, "b": 1}, block_rows=1).collect()
    assert worst_deviation([(r.mix_slot, r.mix_source) for r in rows], {"a": 2, "b": 1}, 5990) < 1
    assert all(r.mix_release <= r.mix_slot < r.mix_due for r in rows)


def test_many_sources_and_weights_of_few(spark):
    docs = spark.range(4800).selectExpr("id doc_id", "if(id % 2 = 0, 'hot', cast(id % 2400 as string)) source")
    weights = {"hot": 1200.0, "1": 1.0}
    rows = mixing.mix_sources(docs, weights=weights, block_rows=1).collect()
    assert len(rows) == 4800
    every = {r.mix_source: weights.get(r.mix_source, 1.0) for r in rows}
    assert len(every) == 1201 and worst_deviation([(r.mix_slot, r.mix_source) for r in rows], every, 4700) < 1


def test_slots_close_up_after_a_source_ends_and_order_stays(spark):
    docs = spark.range(300).selectExpr("id doc_id", "case when id < 10 then 'a' when id < 100 then 'b' else 'c' end source")
    weights = {"a": 3, "b": 2, "c": 1}
    rows = mixing.mix_sources(docs, weights=weights, block_rows=1).collect()
    assert sorted(r.mix_slot for r in rows) == list(range(300))
    period, left = list(mixing.turns(mixing.whole_weights(weights))), {"a": 10, "b": 90, "c": 200}
    want = []
    while sum(left.values()):
        for s, _ in period:
            if left[s]:
                left[s] -= 1
                want.append(s)
    assert [r.mix_source for r in sorted(rows, key=lambda r: r.mix_slot)] == want
    for s in weights:
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.mix_slot) if r.mix_source == s] == sorted(r.doc_id for r in rows if r.mix_source == s)


def test_awkward_rows_and_names(spark):
    rows = [(i, s, i, i, i, 7) for i, s in enumerate([None, "", "a", None, "", "a", "a"])] + [(None, "a", 1, 1, 1, 7), (5, "a", 9, 9, 9, 7), (5, "a", 5, 5, 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, s long, block long, `_n` long, mix_slot long")
    got = mixing.mix_sources(docs, block_rows=2).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.source or "", r.s, r.block, r._n) for r in got if r.doc_id is not None) == sorted((True, a, b or "", c, d, e) for a, b, c, d, e, _ in rows if a is not None)
    assert len(got) == len(rows) and len({(r.mix_slot, r.mix_place) for r in got}) == len(rows)
    assert {(r.mix_source, r.mix_block) for r in got} == {(None, 0), ("", 0), ("a", 0), ("a", 1), ("a", 2)}
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, weights={"a": 0})
    none = spark.createDataFrame([], docs.schema)
    assert mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize("blocks", [{"a": 1, "b": 1, "c": 1}, {"a": 40, "b": 3, "c": 0}, {"a": 2, "b": 900, "c": 5}])
def test_slots_needed_hold_every_block(blocks):
    weights = {"a": 501, "b": 333, "c": 170}
    slots = mixing.slots_needed(weights, blocks)
    said = list(mixing.turns(weights, slots))
    assert said == list(mixing.turns(weights))[:slots] and slots <= 1004
    for s, n in blocks.items():
        assert {i for t, i in said if t == s} >= set(range(min(n, weights[s])))


def test_weights_of_nine_digits_make_only_the_slots_that_the_table_uses(spark, monkeypatch):
    weights = {"a": 0.123456789, "b": 0.876543211, "c": 0.333333333}
    assert sum(mixing.whole_weights(weights).values()) == 1333333333
    made, turns = [], mixing.turns
    monkeypatch.setattr(mixing, "turns", lambda *a: (made.append(1) or t for t in turns(*a)))
    docs = spark.range(6000).selectExpr("id doc_id", "element_at(array('a', 'b', 'c'), cast(id % 3 as int) + 1) source")
    rows = mixing.mix_sources(docs, weights=weights, block_rows=1).collect()
    assert len(made) == -(-2000 * 1333333333 // 123456789)
    assert sorted(r.mix_slot for r in rows) == list(range(6000))
    assert worst_deviation([(r.mix_slot, r.mix_source) for r in rows], weights, 2000 * 1333333333 // 876543211 - 1) < 1


def test_ranges_of_slots_give_the_same_mixture(spark, monkeypatch):
    docs = spark.range(900).selectExpr("id doc_id", "if(id < 30, 'a', if(id % 3 = 0, 'b', 'c')) source")
    rows = lambda: sorted((r.doc_id, r.mix_slot, r.mix_place) for r in mixing.mix_sources(docs, weights={"a": 3, "b": 800, "c": 400}, block_rows=1).collect())
    want = rows()
    monkeypatch.setattr(mixing, "SLOTS_AT_ONCE", 50)
    assert rows() == want and sorted(s for _, s, _ in want) == list(range(900))
