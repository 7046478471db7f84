"""Plain Python versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, k=5):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(rows):
    """Counter of (doc_id, n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = doc if least.get(r) is None else least[r] if doc is None else min(doc, least[r])
    return Counter((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def item_matches(docs, items, percent=75):
    """{(doc_id, item_id): best similarity} over all windows of the items' sizes."""
    out = {}
    for doc, text in docs:
        w = (text or "").lower().split()
        for item, item_text in items:
            v = (item_text or "").lower().split()
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            b = Counter(tuple(v[i:i + k]) for i in range(len(v) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                x = w[s:s + len(v)]
                a = Counter(tuple(x[i:i + k]) for i in range(len(x) - k + 1))
                both, union = sum((a & b).values()), sum((a | b).values())
                if 100 * both >= percent * union:
                    out[doc, item] = max(out.get((doc, item), 0), both / union)
    return out


def repeated_bytes(texts, length=200):
    """(bytes, removed, spans, sha256 of the rest) per text."""
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[p:p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if times[r[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def shared_words(rows, length):
    """{doc_id: word positions inside runs of ``length`` words that another document holds too}."""
    holders = defaultdict(set)
    for doc, text in rows:
        w = words(text)
        for p in range(len(w) - length + 1):
            holders[tuple(w[p:p + length])].add(doc)
    out = defaultdict(set)
    for doc, text in rows:
        w = words(text)
        for p in range(len(w) - length + 1):
            if len(holders[tuple(w[p:p + length])]) > 1:
                out[doc].update(range(p, p + length))
    return out
