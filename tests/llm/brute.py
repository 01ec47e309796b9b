"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substrings(docs, window=50):
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None and (key not in first or doc < first[key]):
                first[key] = doc
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingle_counts(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def probability_jaccard(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in set(x) & set(y))


def classes(docs, least=0.8):
    parent = {}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    rows = [(d, shingle_counts(t)) for d, t in docs if d is not None]
    for d, _ in rows:
        parent.setdefault(d, d)
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] and rows[b][1] and probability_jaccard(rows[a][1], rows[b][1]) >= least - 1e-9:
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted([(d, find(d)) for d, _ in rows] + [(d, None) for d, _ in docs if d is None], key=str)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def mix_targets(sizes, weights=(1, 2, 3), most=3):
    """sizes by source -> target by source, by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def top_k(vectors, k=10):
    import math

    rows = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({q: a for q, a in rows if q % 100 == 0}.items()):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


__all__ = ["base_spans", "classes", "defaultdict", "mix_targets", "probability_jaccard", "shingle_counts", "substrings", "top_k", "words"]
