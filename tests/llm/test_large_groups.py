"""Groups of suffixes that don't fit in memory."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
from tests.llm import brute  # noqa: E402
from wearstream.llm import jaccard_join, substring_dedup  # noqa: E402


@pytest.mark.parametrize("options", [{}, {"group_suffixes": 32, "bucket_suffixes": 200, "one_in": 1, "least": 10**6}, {"group_suffixes": 32, "bucket_suffixes": 100, "one_in": 1, "least": 2}])
def test_common_short_line_between_other_words(spark, options):
    rng = np.random.default_rng(1)
    other = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows = [(i, f"{other(15)} all rights reserved by us {other(15)}") for i in range(120)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:30])] + [(5, rows[7][1]), (300, None), (301, rows[0][1]), (302, rows[0][1] + " more")]
    rows += [(303, rows[0][1]), (1 << 60, rows[1][1] + " " + rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["row"]["doc_id"], r["row"]["text"]): (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs, **options).collect()}
    plain = brute.repeats_removed([r for r in rows if r[0] != 5])
    changed = (5, 7, 205, 207)  # id 5 has two texts, which the plain version doesn't take
    assert {i: v for (i, _), v in got.items() if i not in changed} == {i: v for i, v in plain.items() if i not in changed}
    assert got[5, rows[5][1]][1] == got[5, rows[7][1]][1] == 0 and got[7, rows[7][1]][1] == got[207, rows[7][1]][1] == 35


def test_frequent_prefixes_are_lengthened():
    rng = np.random.default_rng(2)
    words = np.array([7, 8, 9], np.uint64)
    text = np.concatenate([np.r_[words, rng.integers(10, 1 << 60, 3).astype(np.uint64)] for _ in range(50)])
    k = 5
    one, two = substring_dedup.window_hashes(words, 1)[:1], substring_dedup.window_hashes(words, 2)[:1]
    groups = substring_dedup.groups_of(text, k, substring_dedup.Held(np.r_[one, two]))
    n = len(text) - k + 1
    want = substring_dedup.window_hashes(text, 1)[:n].copy()
    want[::6] = substring_dedup.window_hashes(text, 3)[:n][::6]
    assert (groups == want).all()


def twins():
    """Two unequal words of 1024 bytes that polynomials modulo powers of two don't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_with_equal_polynomials_stay_apart(spark):
    a, b = twins()
    rows = [(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, a), (4, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["row"]["doc_id"]: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(docs, size=3, percent=90).collect()} == {i: i for i in range(1, 5)}


def test_layout_stays(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(1, f"{passage} end"), (2, f"  a\n\tb {passage}\n\nc   d\n"), (3, "x\n y  ")]
    got = {r["row"]["doc_id"]: (r.kept_text, [(s.first, s.words) for s in r.repeats]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), layout=True).collect()}
    assert got == {1: (rows[0][1], []), 2: ("  a\n\tb c   d\n", [(2, 14)]), 3: (rows[2][1], [])}
