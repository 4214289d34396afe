"""The prefix trie against one built of dictionaries."""

from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("wearstream.llm")
from wearstream.llm import prefix_trie as T  # noqa: E402
from wearstream.llm import queries  # noqa: E402

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_turns(rows):
    """{conv_id: turns} of (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}


def plain_branched(own):
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def plain_nodes(turns):
    members = defaultdict(list)
    for c, seq in turns.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: sha256(",".join(map(str, sorted(c for c in members[p] if len(turns[c]) == len(p)))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def got(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def conversations(seed, many=300, words=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(many).tolist():
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, ["user", "assistant", None][turn % 3], [None, "", "hi", "ü\U0001f600", "hello there"][int(rng.integers(0, words))]))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("options", [{}, {"shard_cells": 40, "split_cells": 20}, {"shard_cells": 400, "split_cells": 20}])
@pytest.mark.parametrize("branch", [False, True])
def test_nodes_are_those_of_a_plain_trie(spark, options, branch):
    rows = conversations(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    turns = plain_turns(rows)
    assert got(T.conversation_trie(df, branch=branch, **options)) == plain_nodes(plain_branched(turns) if branch else turns)


def test_awkward_conversations(spark):
    many = 400
    rows = [(c, 1, "user", "same") for c in range(1000, 1000 + many)]  # one conversation, held by most
    rows += [(7, t, "user" if t % 2 else None, f"turn {t % 5}") for t in range(700)] + [(8, t, "user" if t % 2 else None, f"turn {t % 5}") for t in range(650)]  # long and nearly equal
    rows += [(9, None, "b", "x"), (9, None, "a", "y"), (9, None, "a", "y"), (9, -5, None, None), (10, 3, "u", "x" * 300_000), (None, 1, "u", "lost"), (-101, 1, "u", "low"), (-100, 1, "u", "base"), (-100, 2, "u", "base"), (1 << 62, 1, None, "big")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", ids int, depth int").repartition(4)
    turns = plain_turns(rows)
    for options in ({}, {"shard_cells": 64, "split_cells": 32}):
        assert got(T.conversation_trie(df, **options)) == plain_nodes(turns)
    assert got(T.conversation_trie(df, branch=True)) == plain_nodes(plain_branched(turns))
    assert T.conversation_trie(df.where("false")).count() == 0


seqs = st.lists(st.lists(st.integers(-1, 1), max_size=40).map(tuple), min_size=1, max_size=12, unique=True)


@settings(max_examples=200, deadline=None)
@given(seqs)
def test_padded_blocks_sort_and_count_common_turns(items):
    low = np.iinfo(np.int64).min
    ids = [np.array([low if v < 0 else v for v in x], np.int64) for x in items]  # the padding's own value may occur
    n = [len(x) for x in ids]
    rows = T.rows_of(ids, [np.zeros((6, k + 1), np.int64).tobytes() for k in n], [b"\0" * 32 * (k + 1) for k in n])
    order = T.ordered(rows)
    assert [items[i] for i in order] == sorted(items)
    done = sorted(items)
    common = [-1] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(done, done[1:])]
    assert T.shared_turns(rows.taken(order)).tolist() == common


def test_query_reads_the_whole_table(spark, tmp_path):
    rows = conversations(11, many=250, words=5)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert got(queries.op11_prefix_trie(spark, str(tmp_path))) == plain_nodes(plain_branched(plain_turns(rows)))
