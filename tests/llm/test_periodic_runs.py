"""Periodic runs against a search of all periods, and the query against its contract word by word."""

import hashlib
import os
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("wearstream.llm")
from wearstream.llm import periodic_runs as P  # noqa: E402
from wearstream.llm import queries  # noqa: E402


def plain_runs(words):
    """All maximal runs by comparing words q apart, for every q: {(begin, end): smallest q}."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted=True):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
pieces = st.tuples(st.integers(1, 12), st.integers(0, 60), st.integers(1, 4)).map(lambda x: [(i * i + x[2]) % x[0] if x[2] > 1 else i % x[0] for i in range(x[1])])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(pieces, st.lists(st.integers(0, 3), max_size=20)), max_size=5).map(lambda x: sum(x, [])), max_size=5))
def test_runs_are_those_of_all_periods(texts):
    assert [list(map(tuple, r.tolist())) for r in P.runs_of_texts([np.array(t, np.int64) for t in texts])] == [plain_runs(t) for t in texts]


def test_long_periods_runs_in_runs_and_texts_that_polynomials_confuse():
    rng = np.random.default_rng(5)
    long = np.r_[rng.integers(0, 99, 50), np.tile(rng.integers(0, 9000, 777), 5)[:3500], rng.integers(0, 99, 50)]
    inner = np.tile(np.r_[np.zeros(9, int), np.tile([1, 2], 6), rng.integers(3, 9, 10)], 6)
    thue = np.array([bin(i).count("1") % 2 for i in range(4096)])
    twins = np.r_[thue, 1 - thue, thue, 1 - thue, thue, 1 - thue, thue, 1 - thue]
    got = P.runs_of_texts([long, inner, twins, np.zeros(5, int), np.zeros(6, int)])
    assert list(map(tuple, got[0].tolist())) == plain_runs(long.tolist()) and (got[0][:, 2] == 777).any()
    assert list(map(tuple, got[1].tolist())) == plain_runs(inner.tolist()) and len(got[1]) > 12
    assert (0, len(twins), 8192) in set(map(tuple, got[2].tolist()))
    assert list(map(len, got[3:])) == [0, 1]


def test_the_set_depends_on_contexts_and_has_no_holes_but_in_periodic_regions():
    rng = np.random.default_rng(6)
    words = np.r_[rng.integers(0, 4, 300), np.zeros(200, int), rng.integers(0, 4, 300)]
    words[550:650] = words[100:200]
    for t in (4, 8, 16):
        names = P.mix64(words.astype(np.uint64) + np.uint64(1))
        for k in range(t.bit_length() - 1):
            names = P.doubled(names, 1 << k)
        runs = np.array([r for r in plain_runs(words.tolist()) if r[2] <= t // 4], np.int64).reshape(-1, 3)
        found = set(P.synchronising_set(names, t, P.deep_inside(runs, len(words), t)).tolist())
        assert {i - 100 for i in found if 100 <= i <= 200 - 2 * t} == {i - 550 for i in found if 550 <= i <= 650 - 2 * t}
        free = [i for i in range(len(words) - 3 * t) if not found & set(range(i, i + t))]
        assert all(300 - t <= i and i + 3 * t <= 500 + t for i in free) and free


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def test_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    texts = [None, "", " \n\t", "x" * 100_000, "a " * 50, "A a " * 20, "\U0001f600 ü " * 9, " ".join(f"w{x}" for x in rng.integers(0, 50, 3000)), "one two three four", "\xa0 " * 8]
    rows = [(i, t, "s", i) for i, t in enumerate(texts * 4)] + [(None, "b " * 30, None, 1), (None, None, None, 2), (4, "a " * 50, "s", 4), (-(1 << 60), "c d e " * 9, None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, best string, runs int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(queries.op13_periodic_runs(spark, str(tmp_path))) == Counter(plain_row(i, t) for i, t, *_ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.periodic_runs(empty).count() == 0


def test_spans_and_texts_of_the_operator(spark):
    row = P.periodic_runs(spark.createDataFrame([(1, "go to a b a b a b a b end x x x x x x")], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(2, 8, 2), (11, 6, 1)] and tuple(row.best) == (11, 6, 1)
    assert row.n_words == 17 and row.collapsed_text == "go to a b end x"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query_equals_the_plain_version(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert rows_of(queries.op13_periodic_runs(spark, path)) == Counter(plain_row(*d) for d in docs)
