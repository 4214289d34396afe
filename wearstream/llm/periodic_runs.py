"""Runs of words that repeat with a period, by string synchronising sets.

At each dyadic scale t, the set's positions are chosen by hashes of the t words from a place on: a place belongs to the
set if the smallest hash of it and the t next places is its own or the last one's. Whether it does depends on 2t words
only, so equal stretches hold the set's positions at equal places, and each place has one within t words, unless it lies
deep in a highly periodic region. Those regions, whose period is at most t / 4, are the runs that smaller scales have
found, and their inner places are left out, so that a repeated word doesn't fill the set. In a run of period q with
t <= q < 2t and length 4q or more, a position of the set recurs q words on with an equal context of 2t words, and not
before: neighbouring positions of equal contexts propose the period, and the common extensions to both sides, found by
prefix hashes, the run. Proposals are compared word by word before they count; names of stretches come from those of
their halves by a mixing hash, as polynomials modulo powers of two don't tell some periodic texts apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearstream.llm.common import _power_table, mix64, odd_constants, small_batches, words_of

#: A run's least length in periods, and in words.
LEAST_EXPONENT = 4
LEAST_WORDS = 6
#: Words that are searched at a time, in whole texts.
BATCH_WORDS = 1 << 17
NEVER = np.uint64((1 << 64) - 1)


class Prefixes:
    """Prefix sums of a polynomial over words, which compare equally long stretches."""

    def __init__(self, words: np.ndarray):
        up, self.down = _power_table(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def after(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """How many words from a and from b > a on are equal, of the first n."""
        same = np.zeros(len(a), np.int64)
        for step in 1 << np.arange(max(n, 1).bit_length() - 1, -1, -1):
            some = np.flatnonzero(b + same + step <= n)
            at = same[some]
            same[some] += step * (self.of(a[some] + at, step) == self.of(b[some] + at, step))
        return same

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words just before a and just before b > a are equal."""
        same = np.zeros(len(a), np.int64)
        for step in 1 << np.arange(int(a.max(initial=0)).bit_length(), -1, -1):
            some = np.flatnonzero(same + step <= a)
            back = same[some] + step
            same[some] += step * (self.of(a[some] - back, step) == self.of(b[some] - back, step))
        return same


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbouring values."""
    n, have = len(values) - width + 1, 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n])


def doubled(names: np.ndarray, t: int) -> np.ndarray:
    """Names of all stretches of 2t words by those of t words: equal stretches have equal names."""
    return mix64(names[:-t] * odd_constants(1, 4099)[0] + mix64(names[t:] + odd_constants(1, 4100)[0]))


def synchronising_set(names: np.ndarray, t: int, omitted: np.ndarray) -> np.ndarray:
    """The positions of the set at scale t by the names of t words; omitted marks the places in highly periodic regions."""
    marks = mix64(names + odd_constants(1, 4101 + t)[0])
    marks[omitted] = NEVER
    least = sliding_least(marks, t + 1)
    return np.flatnonzero((least != NEVER) & ((least == marks[: len(least)]) | (least == marks[t : t + len(least)])))


def deep_inside(found: np.ndarray, n: int, t: int) -> np.ndarray:
    """Whether the t words from each place on lie in a run found so far whose period is at most t / 4."""
    edge = np.zeros(n - t + 2, np.int64)
    deep = found[(4 * found[:, 2] <= t) & (found[:, 1] - found[:, 0] >= t) & (found[:, 1] <= n)]
    np.add.at(edge, deep[:, 0], 1)
    np.add.at(edge, deep[:, 1] - t + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def stretches(words: np.ndarray, d: int) -> list[tuple[int, int, int]]:
    """All maximal stretches of period d and length 4d or more, by comparing each word with the one d words on."""
    step = np.diff(np.r_[0, (words[:-d] == words[d:]).astype(np.int8), 0])
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + d
    return [(int(s), int(e), d) for s, e in zip(begin, end) if e - s >= LEAST_EXPONENT * d]


def runs_at(words: np.ndarray, prefixes: Prefixes, names: np.ndarray, contexts: np.ndarray, t: int, found: np.ndarray) -> np.ndarray:
    """Maximal runs of length 4q or more whose period q is at least t and less than 2t: begin, end, period.

    names and contexts are those of t and 2t words.
    """
    n = len(words)
    places = synchronising_set(names, t, deep_inside(found, n, t))
    contexts = contexts[places]
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    d = np.diff(places)
    near = (contexts[1:] == contexts[:-1]) & (d >= t) & (d < 2 * t)
    a, d = places[:-1][near], d[near]
    runs = np.stack([a - prefixes.before(a, a + d), a + d + prefixes.after(a, a + d, n), d], axis=1)
    runs = np.unique(runs[runs[:, 1] - runs[:, 0] >= LEAST_EXPONENT * d], axis=0)
    sure = {(s, e, q) for s, e, q in runs.tolist() if (words[s : e - q] == words[s + q : e]).all()}
    for q in {q for s, e, q in runs.tolist() if (s, e, q) not in sure}:  # hashes that agreed by chance
        sure |= set(stretches(words, q))
    known = set(map(tuple, found[:, :2].tolist()))  # their smallest period is smaller
    out = {}
    for s, e, q in sorted(sure, key=lambda r: r[2]):
        if (s, e) not in known:
            out.setdefault((s, e), q)
    return np.array([(s, e, q) for (s, e), q in out.items()], np.int64).reshape(-1, 3)


def runs_of_texts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For texts of word numbers, each one's maximal runs of LEAST_EXPONENT periods and LEAST_WORDS words or more.

    Rows are begin, end and smallest period, by begin and period. Texts are searched side by side, the longest first, with a
    word of its own after each, which no run can hold; a scale reads only the texts that are long enough for it.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    top = max((int(x.max(initial=0)) for x in texts), default=0)
    words = np.concatenate([np.empty(0, np.int64), *(np.r_[texts[i], top + 1 + k] for k, i in enumerate(order))])
    words = mix64(words.astype(np.uint64) + np.uint64(1))
    prefixes, names, found, t = Prefixes(words), words, np.empty((0, 3), np.int64), 1
    while (long := int((sizes >= LEAST_EXPONENT * t).sum())) > 0:
        n = begin[long - 1] + sizes[long - 1] + 1
        contexts = doubled(names[: n - t + 1], t)
        found = np.concatenate([found, runs_at(words[:n], prefixes, names[: n - t + 1], contexts, t, found)])
        names, t = contexts, 2 * t
    found = found[found[:, 1] - found[:, 0] >= LEAST_WORDS]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    at = np.searchsorted(found[:, 0], np.r_[begin, len(words)])
    out = [np.empty((0, 3), np.int64)] * len(texts)
    for k, i in enumerate(order):
        out[i] = found[at[k] : at[k + 1]] - [begin[k], begin[k], 0]
    return out


def strongest(runs: np.ndarray) -> list[int] | None:
    """The run with the most periods, of equal ones the first, then that of the smallest period."""
    if not len(runs):
        return None
    share = (runs[:, 1] - runs[:, 0]) / runs[:, 2]
    rest = runs[share >= share.max() * (1 - 1e-12)]  # those that floating point doesn't tell apart
    return min(rest.tolist(), key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))


def periodic_runs(docs: DataFrame, *, words: Callable[[int | None, str | None], list[bytes]] | None = None) -> DataFrame:
    """Every document with its periodic runs: doc_id, n_words, runs, best, collapsed_text.

    A run is a stretch of words with smallest period q (words q apart are equal) of 4q words and 6 words or more, which
    no neighbouring word extends. runs holds start, length and period (in words from 0) of all of them, by start and
    period; best the one with the greatest length / period (ties: the smallest start, then period; null without runs).
    collapsed_text has the words that lie in no run after that run's first q words, joined by one space. words gives a
    row's words (default: those between ASCII white space).

    A null or wordless text has no words, no runs and the empty collapsed_text; rows with null or repeated ids are judged
    one by one; an empty table gives no rows; other columns aren't read. Texts are whole: nothing is exchanged, and a
    task holds about BATCH_WORDS words or the longest text.
    """
    take = words or (lambda _, text: words_of(text))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in small_batches(batches, 256):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, take(doc_id, text)))
                size += len(held[-1][1])
                if size >= BATCH_WORDS:
                    yield judged(held)
                    held, size = [], 0
        if held:
            yield judged(held)

    one = "struct<start:long,length:long,period:long>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(found, f"doc_id long, n_words long, runs array<{one}>, best {one}, collapsed_text string")


def judged(rows: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    """The result's rows of some documents."""
    number = defaultdict(count().__next__)
    numbers = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for _, w in rows]
    named = lambda r: {"start": r[0], "length": r[1] - r[0], "period": r[2]}
    runs, best, kept = [], [], []
    for (_, w), own in zip(rows, runs_of_texts(numbers)):
        top = strongest(own)
        runs.append([named(r) for r in own.tolist()])
        best.append(named(top) if top else None)
        if len(own):
            edge = np.zeros(len(w) + 1, np.int64)
            np.add.at(edge, own[:, 0] + own[:, 2], 1)
            np.add.at(edge, own[:, 1], -1)
            w = [x for x, inside in zip(w, (np.cumsum(edge)[:-1] > 0).tolist()) if not inside]
        kept.append(b" ".join(w).decode("utf-8"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(w) for _, w in rows], pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "runs", "best", "collapsed_text"],
    )


def digests(found: DataFrame) -> DataFrame:
    """The runs of each document in short: their number, the best one, and hashes of the runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
