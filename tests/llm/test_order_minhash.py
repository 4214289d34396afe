"""The sketch's numbering and its least products, against plain versions."""

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
from wearstream.llm import common, order_minhash  # noqa: E402

RNG = np.random.default_rng(9)


def plain_numbers(values):
    seen = {}
    return [seen.__setitem__(v, seen.get(v, -1) + 1) or seen[v] for v in values.tolist()]


def plain_places(values, salts, width):
    out = np.empty((len(salts), width), np.int64)
    for t, salt in enumerate(salts):
        rank = values * salt
        for j in range(width):
            out[t, j] = rank.argmin()
            rank[out[t, j]] = np.iinfo(np.uint64).max
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 2047, 2048, 2049, 5000])
def test_numbers_and_least_products_equal_plain_ones(n):
    salts = common.odd_constants(40, 400)
    few, many = RNG.integers(0, max(1, n // 3), n).astype(np.uint64), common.mix64(np.arange(1, n + 1, dtype=np.uint64))
    near = many[RNG.integers(0, max(1, n // 4), n)] ^ RNG.integers(0, 3, n).astype(np.uint64)  # apart in the last bits only
    for values in (few, many, near, np.full(n, (1 << 64) - 1, np.uint64)):
        assert order_minhash.occurrences(values).tolist() == plain_numbers(values)
    for width in range(1, min(n, 3) + 1):
        assert (order_minhash.least_places(many, salts, width) == plain_places(many, salts, width)).all()
