"""What the operators' methods rest on, against plain versions."""

import re
import time

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
from wearstream.llm import licenses, order_minhash, quality_model, quality_rules, tokens, toxicity  # noqa: E402

RNG = np.random.default_rng(11)


def test_composed_machine_equals_the_machines_side_by_side():
    machines = [toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT]
    for _ in range(300):
        states, composed = [m.start for m in machines], toxicity.CLAUSE.start
        for symbol in RNG.choice(toxicity.SYMBOLS, 12):
            steps = [m.step(s, symbol) for m, s in zip(machines, states)]
            states = [s for s, _ in steps]
            composed, factor = toxicity.CLAUSE.step(composed, symbol)
            assert factor == pytest.approx(np.prod([f for _, f in steps]))


def test_targets_outlast_negations_and_clauses_part():
    g = toxicity.Grammar()
    score = lambda t: g.features(t)[0]
    assert score("you are not nice and an idiot") == score("you are very nice and an idiot") > score("they wrote: very nice and an idiot".replace("they", "we"))
    assert score("not an idiot") < score("an idiot") < score("you idiot")
    assert score("she said you idiot") < score("you idiot") and score("she said. you idiot") == score("you idiot")
    assert score("kill") < score("i will kill you and hurt you") and score("a friend") == 0 == score("")


def test_word_vectors_sum_contexts():
    index = quality_model.index_table()
    text = "a b a c b zz"
    r = quality_model.Reading.of(text)
    words = text.split()
    for i, around in enumerate(r.contexts(index)):
        near = [j for j in range(len(words)) if j != i and abs(i - j) <= quality_model.REACH]
        assert np.allclose(around, sum(index[r.units[j]] for j in near))
    vectors = quality_model.word_vectors(np.zeros_like(index), index)
    x = quality_model.pooled(vectors, text)
    assert np.allclose(x[: quality_model.DIMS], np.mean([index[u] for u in r.units], axis=0))
    assert len({int(quality_model.Reading.of(w).units[0]) for w in ("cat", "dog", "the")}) == 3
    assert len(quality_model.pooled(vectors, None)) == len(x) == len(quality_model.pooled(vectors, ""))
    assert abs(index).sum(1).max() <= quality_model.NONZERO


def test_network_learns_and_is_calibrated():
    x = RNG.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality_model.train_network(np.zeros((1, 1)), x[:500], y[:500], epochs=300)
    assert ((net.probability(x[500:]) > 0.5) == y[500:]).mean() > 0.85 and net.temperature > 0


def least_edits(phrase, line):
    """The fewest edits between a phrase and any part of a line."""
    row = [0] * (len(line) + 1)
    for i, p in enumerate(phrase, 1):
        new = [i]
        for j, c in enumerate(line, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_notices_within_their_edits_are_found():
    phrase, k = "mozilla public license", 2
    scanner = licenses.Scanner({}, [(phrase, "mpl", k)])
    letters = list("abcdefghilmopzxyz ")
    for n in range(200):
        part = list(phrase)
        for _ in range(RNG.integers(0, 5)):
            at = int(RNG.integers(0, len(part)))
            kind = RNG.integers(0, 3)
            part[at : at + int(kind != 1)] = [str(RNG.choice(letters))] if kind else []
        text = " ".join(["some words", "".join(part), "and more"])
        line = f" {' '.join(text.split())} "
        _, _, labels, spans = scanner.scan(text)
        assert (labels | {s[0] for s in spans} == {"mpl"}) == (least_edits(phrase, line) <= k), text
        for _, first, last, edits, _ in spans:
            words = text.split()
            assert 0 <= first <= last < len(words) and edits <= k
            assert least_edits(phrase, f" {' '.join(words[max(0, first - 1) : last + 2])} ") <= k


def test_many_hits_in_a_long_text_take_no_quadratic_time():
    began = time.perf_counter()
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    n, starts, labels, _ = scanner.scan("released under the MIT license. " * 20000)
    assert (n, len(starts), starts[1]) == (100000, 20000, 6) and labels == {"mit"} and time.perf_counter() - began < 30


def test_long_runs_are_redacted_in_linear_time():
    pattern = re.compile(tokens.PRIVATE)
    began = time.perf_counter()
    for text in ("a" * 200_000, "a@" + "b" * 200_000, "1" * 4 + "-" * 200_000, "a." * 100_000 + "@", "1-" * 100_000):
        list(pattern.finditer(text))
    assert time.perf_counter() - began < 5
    assert [m.group() for m in pattern.finditer("to a.b+c@d-e.org, or x@y, 12345 and +49(0)30/1234 not 1234")] == ["a.b+c@d-e.org", "12345", "+49(0)30/1234"]


def test_sketch_equals_a_plain_order_minhash():
    """Two texts agree in a tuple as often as the plain method says: the least numbered k-mers in text order."""
    from wearstream.llm.common import mix64, odd_constants, window_hashes

    for text in ("banana banana bandana", "abcde", "abc", "", "aaaaaaaaaa"):
        chars = np.array([ord(c) for c in text], np.uint64)
        k = min(5, len(text))
        mers = [int(x) for x in (window_hashes(chars, k, seed=9) if k else np.zeros(1, np.uint64))]
        seen, numbered = {}, []
        for m in mers:
            numbered.append((m, seen.setdefault(m, 0)))
            seen[m] += 1
        rank = mix64(np.array(mers, np.uint64) + mix64(np.array([n for _, n in numbered], np.uint64) + np.uint64(1)))
        want = []
        for t, salt in enumerate(odd_constants(40, 400), 1):
            order = sorted(range(len(mers)), key=lambda i: int(rank[i] * salt))[:2]
            value = np.uint64(t)
            for i in sorted(order):
                value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mers[i]))
            want.append(int(value) & 0xFFFFFFFF)
        assert order_minhash.sketch(text).tolist() == want


def test_likeness_falls_with_edits():
    words = [str(x) for x in RNG.integers(0, 10**6, 400)]
    text = " ".join(words)
    like = lambda t: order_minhash.likeness(order_minhash.sketch(text), order_minhash.sketch(t))
    swapped = " ".join(words[200:] + words[:200])
    assert like(text) == 1 > like(" ".join(words[:-5])) > like(" ".join(words[:200])) > like("other words altogether")
    assert like(swapped) < 1


def test_cascade_orders_by_what_is_left_per_second():
    cost = {"a": 1.0, "b": 0.1, "c": 2.0, "d": 1.0, "e": 0.5}
    hits = [(frozenset("a"), 5), (frozenset("b"), 1), (frozenset("c"), 30), (frozenset(), 100)]
    assert quality_rules.cascade(cost, hits) == ["c", "b", "a", "e", "d"]
    both = [(frozenset("ca"), 30), (frozenset("b"), 1), (frozenset("a"), 1)]  # what c rejects isn't counted for a again
    assert quality_rules.cascade(cost, both) == ["a", "b", "e", "d", "c"]


def test_verdicts_do_not_depend_on_the_order(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["word " * 5, "### " * 20, "!!! ok " * 6 + "other words that are here and do differ a lot from those", None, "1234 5678 9012 " + " ".join(str(x) for x in range(40)), "plain words go on and on without end or any other fault"])], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.failed_rule) for r in quality_rules.quality_rules(docs).collect()}
    assert got == {0: (False, "base"), 1: (False, "base"), 2: (False, "base"), 3: (False, "base"), 4: (False, "few_letters"), 5: (True, None)}
    for order in (["few_letters", "symbols"], ["symbols", "few_letters"]):
        rules = {name: quality_rules.RULES[name] for name in order}
        assert {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, rules=rules).collect()} == {i: i == 5 for i in range(6)}


def test_counts_are_free_and_rejected_rows_skip_what_reads_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(30)) + ("#" * 40 if i % 2 else "")) for i in range(2000)] + [(9999, "short")], "doc_id long, text string")
    cost, hits = quality_rules.measured(docs, quality_rules.RULES, 2000)
    assert cost["symbols"] == cost["long_words"] == quality_rules.FREE and cost["few_letters"] >= quality_rules.FREE
    assert sum(n for _, n in hits) <= 2000 and any("symbols" in h for h, _ in hits)
    odd = "if(text like '%#%' or n_words < 10, raise_error('read'), false)"  # would fail on rows that other rules reject
    rows = quality_rules.quality_rules(docs, rules={"dear": odd, "symbols": quality_rules.RULES["symbols"]}, sample_rows=0)
    with pytest.raises(Exception, match="read"):
        rows.collect()  # unmeasured rules stay as given, and the dear one comes first
    some = quality_rules.counted(docs)
    cheap = quality_rules.cascade({"dear": 1.0, "symbols": quality_rules.FREE}, [(frozenset(["symbols"]), 5)])
    verdict = quality_rules.F.when(quality_rules.F.expr(quality_rules.BASE), True)
    for name in cheap:
        verdict = verdict.when(quality_rules.F.expr({"dear": odd, "symbols": quality_rules.RULES["symbols"]}[name]), True)
    assert some.select(verdict.otherwise(False).alias("no")).where("no").count() > 1000


def plain_clause(grammar, words):
    """A clause's weight word by word, from the machines' rules in words."""
    total, near, told, denied = 0.0, False, False, 0
    for w in words:
        kind, weight = grammar.entry(w)
        factor = {"insult": 1.0, "threat": 0.3}.get(kind, 1.0)
        if near:
            factor *= {"insult": 1.25, "threat": 3.0}.get(kind, 1.0)
        if denied and kind != "negation":
            factor *= {"insult": 0.5, "threat": 0.3}.get(kind, 1.0)
        if told:
            factor *= {"insult": 0.5, "threat": 0.3}.get(kind, 1.0)
        if kind in ("insult", "threat"):
            total += factor * weight
        denied = 2 if kind == "negation" else max(denied - 1, 0)
        near, told = near or kind == "target", told or kind == "report"
    return total


def test_the_grammar_tells_negated_and_reported_insults_where_words_alone_do_not(spark):
    rng = np.random.default_rng(3)
    fill = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(fill, n))
    bad = toxicity.INSULTS[:8]
    rows = [(i, f"{prose(12)}. you are a {bad[i % 8]}. {prose(12)}." if i % 2 else f"{prose(12)}. {prose(12)}.", i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    grammar = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), "true")
    flat = toxicity.Grammar(grammar.words, grammar.stems, grammar.coef)
    flat.arcs = {s: [(to, 1.0) for to, _ in row] for s, row in grammar.arcs.items()}
    texts = lambda form: [f"{prose(12)}. {form.format(w)}. {prose(12)}." for w in bad]
    flagged = lambda g, form: np.mean([g.score(t) >= 0.5 for t in texts(form)])
    assert flagged(grammar, "you {0}") == flagged(flat, "you {0}") == 1
    for form in ("{0}", "sheer {0}"):
        low = [f"they were not {form}", f"he said {form}", f"she wrote he was never {form}"]
        for one in low:
            direct, mild = np.mean([grammar.score(t) for t in texts(form)]), np.mean([grammar.score(t) for t in texts(one)])
            alike = np.mean([flat.score(t) for t in texts(form)]), np.mean([flat.score(t) for t in texts(one)])
            assert mild < direct and alike[1] >= alike[0] - 1e-9
    words = bad + ["kill", "you", "not", "said", "word1", "word2", "nie"]
    for _ in range(300):
        clause = rng.choice(words, rng.integers(1, 12)).tolist()
        assert grammar.clause(clause) == pytest.approx(plain_clause(grammar, clause))
