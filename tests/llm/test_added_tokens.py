"""Texts with the vocabulary's added token, against the tokenizer of the contract with its defaults."""

import zlib

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
tokenizers = pytest.importorskip("tokenizers")
from wearstream.llm import packing, tokens  # noqa: E402

END = "<|endoftext|>"
TEXTS = [END, f"one {END} two", f"one{END}two  {END}\n\n{END} x", f"a  {END}  b 1234567 {END}", f"{END}{END}", "<|endof text|> <|endoftext|", f"me@x.org{END}x 😀{END} \t" * 40, "plain"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_and_counts_are_the_tokenizers(spark, reference):
    want = [reference.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert 50256 in want[1]
    encode = tokens.Encoder().encode
    assert [list(encode(t)) for t in TEXTS] == want
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    first = {p.doc_id: p for p in packing.pack_documents(docs, end_id=1).collect() if p.start == 0}
    for i, ids in enumerate(want):
        ids = [*ids, 1]
        assert (first[i].doc_tokens, first[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids[: first[i].length], "<u4").tobytes()))
    rows = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {i: len(ids) for i, ids in enumerate(want)}
    assert rows[3].n_edits == 1
    assert rows[3].edited_tokens == len(reference.encode(TEXTS[3].replace("1234567", "[redacted]"), add_special_tokens=False).ids)


def test_edits_that_make_and_break_the_token(reference):
    rng = np.random.default_rng(5)
    count = tokens.Encoder().count
    true = lambda t: len(reference.encode(t, add_special_tokens=False).ids)
    tree = tokens.CountTree(f"some words {END} and <|endof text|> more {END}x " * 8, count, leaf_chars=16)
    bits = ["<|endof", "text|>", END, "", " ", "x", " word"]
    for _ in range(300):
        a = int(rng.integers(0, len(tree.text) + 1))
        b = min(len(tree.text), a + int(rng.integers(0, 5)))
        tree.replace(a, b, bits[rng.integers(0, len(bits))])
        assert tree.total == true(tree.text)
    for broken in ("<|endof text|>", f"y{END}z"):
        at = tree.text.find(broken)
        if at >= 0:
            tree.replace(at + 7, at + 8, "")
            assert tree.total == true(tree.text)
