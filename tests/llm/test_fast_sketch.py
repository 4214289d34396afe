"""Fast similarity sketches by their own properties, and the classes of near-duplicates against all pairs."""

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
from tests.llm import brute  # noqa: E402
from wearstream.llm import fast_sketch as S  # noqa: E402

RNG = np.random.default_rng(31)


def plain_sketch(s, t):
    """Round by round, one element at a time."""
    out, salts = [None] * t, S.odd_constants(2 * t, 7919)
    for r in range(2 * t):
        for x in s:
            h = int(S.mix64(np.array([x], np.uint64) + salts[r])[0])
            i = (h >> 32) * t >> 32 if r < t else r - t
            v = (r << 32) | (h & 0xFFFFFFFF)
            if out[i] is None or v < out[i]:
                out[i] = v
        if None not in out:
            return out


def test_sketches_equal_a_plain_filling_and_every_coordinate_fills():
    sets = [RNG.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 5, 40, 300)]
    got = S.fast_sketches(sets, 16)
    assert [plain_sketch(s.tolist(), 16) for s in sets] == got.tolist()
    assert S.fast_sketches([], 16).shape == (0, 16)
    assert (got[0] >> np.uint64(32)).max() >= 16 and (got[4] >> np.uint64(32)).max() <= 2  # small sets need the last rounds, large ones the first


@pytest.mark.parametrize("n", [10, 60, 2000])
def test_equal_coordinates_are_concentrated_about_the_similarity(n):
    t, shares = 200, []
    for _ in range(100):
        common = RNG.integers(0, 1 << 63, n * 8 // 10).astype(np.uint64)
        rest = RNG.integers(0, 1 << 63, n - len(common)).astype(np.uint64)
        half = len(rest) // 2
        a, b = S.fast_sketches([np.r_[common, rest[:half]], np.r_[common, rest[half:]]], t)
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.8) < 0.02 and np.std(shares) < 1.3 * np.sqrt(0.16 / t)


def test_banding_keeps_the_chance_of_a_miss():
    assert S.banding(200, 80) == (40, 5) and S.least_agreement(200, 80) == 120
    for percent in (50, 80, 95):
        bands, rows = S.banding(200, percent)
        assert (1 - (percent / 100) ** rows) ** bands <= S.MISS and bands * rows <= 200


def near(text, share):
    words = text.split()
    for i in RNG.choice(len(words), int(share * len(words)), replace=False):
        words[i] = f"n{RNG.integers(0, 10**9)}"
    return " ".join(words)


def prose(n):
    return " ".join(f"w{x}" for x in RNG.integers(0, 10**6, n))


def corpus():
    base = [prose(n) for n in (3, 4, 20, 60, 60, 200, 200, 1500)]
    rows = [None, "", "  ", "one", "One", "one two", *base]
    for text in base[2:]:
        rows += [near(text, share) for share in (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1)] + [text.upper()]
    hub = prose(120)
    rows += [hub, *(near(hub, 0.025) for _ in range(150))]  # copies that are near the hub, and not all near each other
    chain = prose(200)
    for _ in range(40):
        chain = near(chain, 0.015)
        rows.append(chain)
    ids = RNG.permutation(len(rows))
    return [(int(i) * 7, t) for i, t in zip(ids, rows)]


@pytest.mark.parametrize("options", [{}, {"tile": 8}])
def test_classes_are_those_of_all_pairs(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(docs, size=4, percent=80, **options).collect()}
    want = brute.jaccard_components(rows, 4, 80)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 150


def test_dense_tiles_are_settled_in_place(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_EACH", 0)
    monkeypatch.setattr(S, "LEADER_BANDS", 99)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(docs, size=4, percent=80, tile=64).collect()} == brute.jaccard_components(rows, 4, 80)


def test_awkward_rows(spark):
    long = prose(20000)
    rows = [(None, long), (None, None), (1, long), (1, long), (1, "a b c d e f"), (2, None), (2, ""), (3, long + " end"), (5, "x" * 300_000), (-(1 << 62), long), (1 << 62, "A b c d e F")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, `key` int, band int, comp int, rep int").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(docs, size=4).collect()), key=str)
    n, low = len(set(zip(*(long.split()[i:] for i in range(4))))), -(1 << 62)
    want = [(True, 0, n, None, True), (True, 0, 0, None, True), (False, 1, n, low, False), (False, 1, n, low, False), (False, 1, 3, 1, True), (False, 2, 0, 2, True), (False, 2, 0, 2, True)]
    want += [(False, 3, n + 1, low, False), (False, 5, 1, 5, True), (False, low, n, low, True), (False, 1 << 62, 3, 1, False)]
    assert got == sorted(want, key=str)
    assert S.near_duplicates(docs.where("false")).count() == 0


def test_a_tile_settles_only_pairs_whose_first_band_it_is():
    a = np.arange(1, 401, dtype=np.uint64)
    sets = [a, a[:-10]]
    bands = S.bands_of(S.fast_sketches(sets, 200), *S.banding(200, 80))
    shared = bands[0][bands[0] == bands[1]].tolist()
    settle = lambda band: S.joined_components(sets, np.array([1, 2]), np.array([0, 0]), 120, 80, 200, band)
    assert len(shared) > 1 and len(settle(shared[0])) == 1 and [settle(b) for b in shared[1:]] == [[]] * (len(shared) - 1)
