"""Brute-force versions of the corpus operators, straight from their contracts."""

import hashlib
import re
from collections import Counter

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(rb"[^\x20\x09-\x0D]+")


def decontaminate(docs, items):
    """[(doc_id, text)], [(item_id, text)] -> {doc_id: (n_words, n_hit, n_items, sha256, contaminated)}"""
    words = lambda t: ALNUM.findall((t or "").encode().translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, ids = [0] * len(w), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if found := known.get(tuple(w[k : k + n])):
                    ids |= found
                    hit[k : k + n] = [1] * n
        out[doc] = (len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), sum(hit) > 0)
    return out


def shingles(text, n=5):
    w = SOLID.findall((text or "").encode().translate(LOWER))
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def jaccard(docs, percent=80):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in docs}
    holders, parent = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = Counter(y for x in s for y in holders[x] if y < d)
        for y, m in shared.items():
            if 100 * m >= percent * (len(s) + len(sets[y]) - m):
                a, b = find(d), find(y)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated(docs, length=400):
    """[(key, text)] -> {key: (n_bytes, n_removed, n_spans, sha256)}; equal texts under one key count twice."""
    count = Counter()
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            count[hash(b[i : i + length])] += 1
    out = {}
    for d, b in raw:
        gone, reach = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if count[hash(b[i : i + length])] > 1:
                s = max(i, reach)
                gone[s : i + length] = b"\1" * (i + length - s)
                reach = i + length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
