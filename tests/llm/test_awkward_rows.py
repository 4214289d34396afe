"""All ten operators on null ids, equal rows, one id with two texts, very long texts, ties, and columns with clashing names."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
from tests.llm import brute  # noqa: E402
from wearstream.llm import jaccard_join, licenses, mixing, order_minhash, packing, quality_model, quality_rules, substring_dedup, tokens, toxicity  # noqa: E402

RNG = np.random.default_rng(21)
LONG = " ".join(f"w{x}" for x in RNG.integers(0, 5000, 20000))
A, B = (" ".join(f"v{x}" for x in RNG.integers(0, 10**6, 40)) for _ in range(2))
ROWS = [(None, A), (None, None), (1, A), (1, A), (1, B), (2, None), (2, ""), (3, LONG), (4, LONG + " end"), (5, "x" * 300_000), (6, "\n\t \x0b"), (7, "�\U0001f600 ü"), (-(1 << 62), A), (1 << 62, B)]
#: Names that the operators use inside.
NAMES = ["row", "id", "s", "r", "b", "n", "part", "bucket", "word", "mask", "hash", "key", "marks", "text_key", "set_key", "rep", "block", "label", "y", "x", "score", "kept", "tie", "packed", "end", "mix_slot", "touched", "gone"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in NAMES)
    rows = [(i, t, None, None if i is None else f"s{i % 2}", len(t or ""), *range(len(NAMES))) for i, t in ROWS]
    return spark.createDataFrame(rows, schema).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (2, 1, None), (None, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


IDS = Counter(i for i, _ in ROWS)


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_row_by_row_operators_keep_every_row(docs, labels):
    for df in (quality_rules.quality_rules(docs), licenses.scan_licenses(docs), tokens.count_tokens(docs), toxicity.score_toxicity(docs, labels), quality_model.score_quality(docs, labels)):
        assert ids(df) == IDS
    counts = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs).collect())
    assert counts == Counter((i, *brute.quality_counts(t)) for i, t in ROWS)
    assert Counter((r.doc_id, r.n_words, r.n_base) for r in licenses.scan_licenses(docs).collect()) == Counter((i, *brute.license_base(t)[:2]) for i, t in ROWS)


def test_packing_packs_every_row(docs):
    pieces = packing.pack_documents(docs).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == IDS
    encode = tokens.Encoder().count
    assert sum(p.length for p in pieces) == sum(encode(t or "") + 1 for _, t in ROWS)
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 2048


def test_jaccard_groups_by_id_and_text(docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs, size=3, percent=90).collect())
    low, n_long = -(1 << 62), len({tuple(LONG.split()[i : i + 3]) for i in range(19998)})
    want = Counter({(1, 38, low): 2, (low, 38, low): 1, (1, 38, 1): 1, (1 << 62, 38, 1): 1, (2, 0, 2): 2, (3, n_long, 3): 1, (4, n_long + 1, 3): 1, (5, 1, 5): 1, (6, 0, 6): 1, (7, 1, 7): 1})
    assert got == want
    kept = jaccard_join.keep_first(docs, size=3, percent=90)
    assert kept.columns == docs.columns
    assert ids(kept) == Counter({None: 2, low: 1, 1: 1, 2: 2, 3: 1, 5: 1, 6: 1, 7: 1})  # of id 1 the text that the smallest id lacks


def test_repeats_go_by_the_smallest_id(docs):
    cut = substring_dedup.remove_repeats(docs)
    got = Counter((r["row"]["doc_id"], r.n_words, r.n_removed) for r in cut.collect())
    low = -(1 << 62)
    assert got == Counter({(None, 40, 0): 1, (None, 0, 0): 1, (1, 40, 40): 2, (1, 40, 0): 1, (2, 0, 0): 2, (3, 20000, 0): 1, (4, 20001, 20000): 1, (5, 1, 0): 1, (6, 0, 0): 1, (7, 2, 0): 1, (low, 40, 0): 1, (1 << 62, 40, 40): 1})
    assert all(r["row"]["gone"] == NAMES.index("gone") for r in cut.collect())


def test_mixing_and_fingerprints_keep_every_row(docs):
    assert ids(mixing.mix_sources(docs, block_rows=2)) == IDS
    rows = order_minhash.fingerprint_documents(docs).collect()
    assert Counter(r.doc_id for r in rows) == IDS
    marks = {}
    for r in rows:
        marks.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert marks[1, len(A)] | marks[-(1 << 62), len(A)] >= marks[None, len(A)]
    top = next(r for r in rows if r.doc_id == 1 << 62)  # the largest id comes first and 7 next
    following = ROWS[11][1]
    half = len(B) // 2
    assert top.edited_sha256 == hashlib.sha256((B[: len(B) - half] + following[:half]).encode()).hexdigest()
