"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearstream.llm.common import labelled_sample, small_batches

CLAUSE_END = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"\w+")

#: Seeds of the grammar's word classes; insults are learned besides these.
INSULTS = "idiot moron loser scum stupid disgusting worthless pathetic trash imbecile dummkopf abschaum wertlos idiota basura imbécil connard ordure minable".split()
THREATS = "kill hurt destroy punish töten vernichten matar destruir tuer détruire".split()
TARGETS = "you your he she they them du ihr euch tú usted vosotros tu vous toi".split()
NEGATIONS = "not never no isn aren nicht kein keine nunca jamás ne pas jamais".split()
REPORTS = "said says wrote quoted reported claimed sagte schrieb dijo escribió dit écrivit".split()

SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")


@dataclass(frozen=True)
class Machine:
    """A weighted transducer over word classes: (state, class) -> (next state, factor on a matched word's weight).

    Where it has no arc it stays in its state and leaves the weight alone.
    """

    start: object
    arcs: dict

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, 1.0))


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines on one tape: pairs of states that can be reached, with the product of the factors."""
    start, arcs = (a.start, b.start), {}
    todo, seen = [start], {start}
    while todo:
        x, y = todo.pop()
        for symbol in SYMBOLS:
            (nx, fa), (ny, fb) = a.step(x, symbol), b.step(y, symbol)
            arcs[(x, y), symbol] = ((nx, ny), fa * fb)
            if (nx, ny) not in seen:
                seen.add((nx, ny))
                todo.append((nx, ny))
    return Machine(start, arcs)


#: Insults count in full and threats little by themselves; after a target, to the clause's end, both count more. The two
#: words after a negation, and all words after a verb of speech, count less.
INSULT = Machine("insult", {})
THREAT = Machine("threat", {("threat", "threat"): ("threat", 0.3)})
TARGET = Machine("far", {("far", "target"): ("near", 1.0), ("near", "insult"): ("near", 1.25), ("near", "threat"): ("near", 3.0)})
NEGATION = Machine("off", {
    ("off", "negation"): (2, 1.0), (2, "negation"): (2, 1.0), (1, "negation"): (2, 1.0),
    **{(n, s): (n - 1 or "off", f) for n in (2, 1) for s, f in (("insult", 0.5), ("threat", 0.3), ("target", 1.0), ("report", 1.0), ("other", 1.0))},
})
REPORT = Machine("direct", {("direct", "report"): ("told", 1.0), ("told", "insult"): ("told", 0.5), ("told", "threat"): ("told", 0.3)})
CLAUSE = compose(compose(compose(compose(INSULT, THREAT), TARGET), NEGATION), REPORT)


@dataclass
class Grammar:
    """words and stems: weights of the insult transducer's entries; coef: the clause features' weights in the score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray | None = None

    def __post_init__(self):
        self.fixed = {w: (name, 3.0) for name, words in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS), ("insult", INSULTS)) for w in words}
        self.cache: dict[str, tuple[str, float]] = {}
        number = {state: i for i, state in enumerate(dict.fromkeys(state for state, _ in CLAUSE.arcs))}
        self.arcs = {symbol: [CLAUSE.step(state, symbol) for state in number] for symbol in SYMBOLS}
        self.arcs = {symbol: [(number[to], factor) for to, factor in row] for symbol, row in self.arcs.items()}
        self.start = number[CLAUSE.start]

    def entry(self, word: str) -> tuple[str, float]:
        """A word's class and weight: by its own entry, else by its best stem's, else by the fixed classes."""
        if word in self.words:
            return "insult", self.words[word]
        stem = max((word[:n] for n in range(4, len(word)) if word[:n] in self.stems), key=self.stems.get, default=None)
        return ("insult", self.stems[stem]) if stem else self.fixed.get(word, ("other", 0.0))

    def clause(self, words: list[str]) -> float:
        """The sum of the weights that the composed machine gives a clause's matched words; 0 without a match."""
        cache, state, total = self.cache, self.start, 0.0
        for w in words:
            found = cache.get(w)
            if found is None:
                if len(cache) > 300_000:
                    cache.clear()
                found = cache[w] = self.entry(w)
            kind, weight = found
            state, factor = self.arcs[kind][state]
            if weight and kind in ("insult", "threat"):
                total += factor * weight
        return total

    def features(self, text: str) -> list[float]:
        """Of a text's clauses: sum, maximum and mean of scores, matched clauses, their share, whether any matched, and 1."""
        clauses = [words for clause in CLAUSE_END.split(text.lower()) if (words := WORD.findall(clause))]
        scores = [score for score in map(self.clause, clauses) if score]
        best = max(scores, default=0.0)
        n = len(clauses) or 1
        return [np.log1p(sum(scores)), np.log1p(best), np.log1p(sum(scores) / n), np.log1p(len(scores)), len(scores) / n, 1.0 if scores else 0.0, 1.0]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.features(text), self.coef))))


def patterns(text: str) -> set[str]:
    """What the insult transducer may learn from a text: its words, and stems that at least two of its words continue."""
    words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
    stems: dict[str, int] = {}
    for w in words:
        for n in range(4, len(w)):
            stems[w[:n]] = stems.get(w[:n], 0) + 1
    return {w + "$" for w in words} | {s for s, n in stems.items() if n > 1}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, train: str, *, max_rows: int = 8000) -> Grammar:
    """A grammar whose entries and weights come from at most max_rows labelled rows that satisfy train.

    A word or stem enters if toxic texts hold it far oftener than others (the lower bound of its log odds is over 1.5),
    unless a shorter stem of it enters with at least its weight; the sample bounds how many do. Without toxic rows the
    seeds alone score.
    """
    sample = labelled_sample(docs, labels, "toxic", train, max_rows)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            rows = [(p, y) for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in patterns(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["pattern", "y"])

    counts = sample.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in counts}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    bound = odds - 1.3 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = (
        sample.mapInArrow(candidates, "pattern string, y int").groupBy("pattern").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        .where("a >= 4").withColumn("weight", bound).where("weight > 1.5")
        .select("pattern", "weight").collect()
    )
    stems = {r[0]: r[1] for r in found if not r[0].endswith("$")}
    covered = lambda word, weight, longest: any(stems.get(word[:n], 0.0) >= weight for n in range(4, longest))
    words = {r[0][:-1]: r[1] for r in found if r[0].endswith("$") and not covered(r[0][:-1], r[1], len(r[0]) - 1)}
    grammar = Grammar(words, {s: w for s, w in stems.items() if not covered(s, w, len(s))})

    def clauses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array([grammar.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample.mapInArrow(clauses, "x array<double>, y int").collect()
    if n1 and n0:
        grammar.coef = logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
    else:
        grammar.coef = np.array([0.0, 2.0, 1.0, 0.5, 1.0, 1.0, -3.0])
    return grammar


def score_toxicity(docs: DataFrame, labels: DataFrame, *, train: str = "true", threshold: float = 0.7, max_rows: int = 8000) -> DataFrame:
    """Every document's toxicity: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Clauses are run through the composed transducers; the score is a logistic function of the matched clauses. train is
    a condition on the labels' rows. A null or empty text is scored as one without matches; a null doc_id is kept,
    repeated rows give a row each, very long texts are scored whole, an empty table gives no rows and other columns
    aren't read. Nothing is shuffled but the bounded sample.
    """
    grammar = fit(docs, labels, train, max_rows=max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = np.array([grammar.score(t or "") for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
