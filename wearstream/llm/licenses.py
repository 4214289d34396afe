"""License scan: exact seeds find candidates of short notices, bounded-error matching verifies them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wearstream.llm.common import ALNUM, LOWER, small_batches

#: Phrases whose words count where they stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the fuzzy search looks for, with the edits it allows.
NOTICES = [
    ("under the mit license", "mit", 2), ("apache license version 2", "apache-2", 2), ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("gnu general public license version 3", "gpl-3", 3), ("gnu lesser general public license", "lgpl", 3), ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4), ("permission is hereby granted free of charge", "mit", 4),
]
#: All bytes that aren't part of a word become spaces; capitals become small.
TO_WORDS = bytes(LOWER[b] if ALNUM[LOWER[b]] else 0x20 for b in range(256))


class Scanner:
    """Each task makes one: an automaton of the notices' seeds, and a pattern for each notice."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str, int]]):
        import ahocorasick
        import regex

        self.phrases, self.notices = phrases, notices
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(p, special_only=True)}){{e<={k}}}") for p, _, k in notices]
        seeds: dict[str, list] = {}
        for n, (phrase, _, k) in enumerate(notices):
            cuts = np.linspace(0, len(phrase), k + 2).astype(int)
            for a, b in zip(cuts, cuts[1:]):  # k edits leave one of k + 1 pieces whole
                seeds.setdefault(phrase[a:b], []).append(("notice", n, int(a)))
        for n, phrase in enumerate(phrases):
            seeds.setdefault(f" {phrase} ", []).append(("phrase", n, 0))
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], set[str], list[tuple]]:
        """Words, first words of the phrases' places, their labels, and the verified spans: label, first word, last word, edits, share kept."""
        words = (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()
        line = f" {b' '.join(words).decode()} "
        starts, labels, near, spaces = [], set(), {}, []

        def word_at(place: int) -> int:
            """How many spaces stand before a place."""
            if not spaces:
                spaces.extend(i for i, c in enumerate(line) if c == " ")
            return bisect_left(spaces, place)

        names = list(self.phrases)
        for end, (size, where) in self.automaton.iter(line):
            for kind, n, offset in where:
                at = end - size + 1
                if kind == "phrase":
                    starts.append(word_at(at))
                    labels.add(self.phrases[names[n]])
                else:
                    phrase, _, k = self.notices[n]
                    near.setdefault(n, []).append((max(0, at - offset - k), at - offset + len(phrase) + k))
        spans = []
        for n, windows in near.items():
            phrase, label, k = self.notices[n]
            reach = -1
            for a, b in sorted(windows):
                if a < reach:  # inside the last match
                    continue
                m = self.patterns[n].search(line, a, b)
                if m and m.end() > m.start():
                    edits = sum(m.fuzzy_counts)
                    spans.append((label, max(0, word_at(m.start() + 1) - 1), max(0, word_at(m.end()) - 1), edits, 1 - edits / len(phrase)))
                    reach = m.end() - k
        return len(words), starts, labels, spans


def scan_licenses(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, first, last, edits).

    score is 1 where a phrase stands exactly, else the best verified notice's share of unedited characters, else 0. A
    null text is empty: no words, no labels, null first_word and last_word. A null doc_id is kept, repeated rows give a
    row each, an empty table gives no rows and other columns aren't read. Texts are whole; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in small_batches(batches):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in batch.column(1).to_pylist():
                n, starts, labels, spans = scanner.scan(text)
                for k, v in {
                    "n_words": n, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(labels)),
                    "labels": ",".join(sorted(labels | {s[0] for s in spans})), "score": 1.0 if starts else max((s[4] for s in spans), default=0.0),
                    "spans": [{"label": a, "first": b, "last": c, "edits": d} for a, b, c, d, _ in spans],
                }.items():
                    out[k].append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=["doc_id", *out])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,edits:long>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
