"""The operators against plain versions on a small table of awkward rows."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
from tests.llm import brute  # noqa: E402
from wearstream.llm import jaccard_join, licenses, mixing, order_minhash, packing, quality_model, quality_rules, substring_dedup, tokens, toxicity  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()
RNG = np.random.default_rng(3)
PASSAGE = " ".join(RNG.choice(WORDS, 20))


def table():
    base = list(RNG.choice(WORDS, 120))
    rows = [(i, " ".join(RNG.choice(WORDS, n))) for i, n in enumerate((1, 2, 3, 12, 13, 14, 40, 200, 3000))]
    rows += [(20 + i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(0, 30, 3)] + [(50, " ".join(base)), (51, " ".join(base)), (52, " ".join(base[:-1]))]
    rows += [(60 + i, f"{i} before {PASSAGE} after {i}\nsame line\nsame line") for i in range(5)]
    rows += [(70, None), (71, ""), (72, " \t\n"), (73, "Released under the MIT License.\nünïcödé 😀 # $ $"), (74, "apache license versoin 2 cc by nc"), (75, "a a a a a a a a a a a a a")]
    return rows


ROWS = table()


@pytest.fixture(scope="module")
def docs(spark):
    # n_shingles and key clash with names the operators use
    df = spark.createDataFrame([(i, t, "en", "hot" if i % 3 else "cold", len(t or ""), 1, "x") for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, n_shingles long, key string")
    return df.repartition(5).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i % 7 == 0)) for i, _ in ROWS], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("size,percent,tile", [(3, 90, 2000), (5, 80, 3), (1, 60, 4)])
def test_jaccard_groups(docs, size, percent, tile):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs, size=size, percent=percent, tile=tile).collect()}
    assert got == brute.jaccard_components(ROWS, size, percent)


def test_heavy_light_finds_every_link():
    sets = [np.unique(RNG.integers(0, 30, n).astype(np.uint64)) for n in RNG.integers(1, 25, 80)]
    for percent in (50, 80, 90):
        want = {(i, j) for i in range(80) for j in range(i + 1, 80) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        got = [(min(i, int(j)), max(i, int(j))) for i, others in jaccard_join.heavy_light(sets, None, percent) for j in others]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("options", [{}, {"one_in": 1, "least": 2}])
def test_remove_repeats(docs, options):
    got = {r["row"]["doc_id"]: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs, **options).collect()}
    assert got == brute.repeats_removed(ROWS)


def test_quality_counts(docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs).collect()}
    assert got == {i: brute.quality_counts(t) for i, t in ROWS}


def test_licenses(docs):
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in rows.items()} == {i: brute.license_base(t) for i, t in ROWS}
    assert rows[74].labels == "apache-2,cc-by-nc" and rows[74].spans[0].edits in (1, 2)


def test_mixing_stays_within_a_block(docs):
    rows = mixing.mix_sources(docs, weights={"hot": 2, "cold": 1}, block_rows=1).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in ROWS)


def test_fingerprints(docs):
    got = {r.doc_id: r for r in order_minhash.fingerprint_documents(docs).collect()}
    texts, ids = {i: t or "" for i, t in ROWS}, sorted((i for i, _ in ROWS), reverse=True)
    for at, i in enumerate(ids):
        a, b = texts[i], texts[ids[(at + 1) % len(ids)]]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(a)
        assert got[i].fingerprint == order_minhash.sketch(a).tobytes().hex() and 0 <= got[i].near_next <= 1
    assert got[50].fingerprint == got[51].fingerprint and got[51].near_next == 1


def test_packing(docs):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs).collect()
    for i, t in ROWS:
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(ids)
    filled: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 2048


def test_token_counts_after_edits(docs):
    count = tokens.Encoder().count
    for text in ("mail me at a.b@c.de or 123456 now " * 30, "", "x"):
        tree = tokens.CountTree(text, count, leaf_chars=16)
        for _ in range(20):
            a = int(RNG.integers(0, len(tree.text) + 1))
            tree.replace(a, min(len(tree.text), a + int(RNG.integers(0, 9))), " new text"[: int(RNG.integers(0, 10))])
            assert tree.total == count(tree.text)
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()} == {i: count(t or "") for i, t in ROWS}


def test_models_score_every_row(docs, labels):
    for f in (toxicity.score_toxicity, quality_model.score_quality):
        rows = f(docs, labels).collect()
        assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert all(0 <= r.score <= 1 for r in f(docs, labels.where("false")).collect())


def test_grammar_states():
    g = toxicity.Grammar()
    best = lambda t: g.features(t)[1]
    assert best("you idiot") > best("an idiot") > best("not an idiot") > best("a friend")


def test_empty_table(docs, labels, spark):
    none = spark.createDataFrame([], docs.schema)
    for df in (jaccard_join.jaccard_groups(none), substring_dedup.remove_repeats(none), quality_rules.quality_rules(none), licenses.scan_licenses(none), mixing.mix_sources(none), order_minhash.fingerprint_documents(none), packing.pack_documents(none), tokens.count_tokens(none), toxicity.score_toxicity(none, labels), quality_model.score_quality(none, labels)):
        assert df.count() == 0
