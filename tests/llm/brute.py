"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def jaccard_components(docs, size=3, percent=90):
    """{doc_id: (set size, component)} for [(doc_id, text)]."""
    sets = {}
    for i, text in docs:
        w = WORD.findall(lower(text or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats_removed(docs, k=13):
    """{doc_id: (n_words, n_removed, sha of kept words)}."""
    first, words = {}, {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out[i] = (len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def quality_counts(text, k=5):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    hit = {j for i in range(len(w) - k + 1) if wins[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at = [(i, label) for i in range(len(w)) for p, label in PHRASES.items() if tuple(w[i : i + len(p)]) == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


