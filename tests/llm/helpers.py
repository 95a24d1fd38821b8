"""Plain restatements of the operators, to compare with."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def table(spark, texts, sources=None):
    """A documents table; texts may be (id, text) pairs."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", sources[n] if sources else "s", len(t or "")) for n, (i, t) in enumerate(pairs)], DOCS)


def near_components(pairs, percent=75):
    """Component of each (id, text), by comparing all pairs."""
    sets = {}
    for i, t in pairs:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(pairs, window=50):
    """(n_words, n_removed, kept words) of each id."""
    first, out = {}, {}
    rows = sorted(pairs)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def repeated_words(w, n=5):
    counts = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    inside = [False] * len(w)
    for j in range(len(w) - n + 1):
        if counts[tuple(w[j : j + n])] > 1:
            inside[j : j + n] = [True] * n
    return sum(inside)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
