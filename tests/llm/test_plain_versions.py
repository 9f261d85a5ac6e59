"""Operators against plain versions of their parts: trees walked node by node, one-permutation MinHash bin by bin."""

import struct

import numpy as np
import xxhash

from sparkveil.llm import fingerprint, quality


def test_trees_walked_node_by_node():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.fit(x, y, trees=20, depth=3)
    scores = trees.score(x)
    inner = trees.feature.shape[1]
    for row, got in zip(x[:100], scores):
        raw = trees.start
        for t in range(len(trees.leaf)):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.cut[t, node] else 1)
            raw += trees.leaf[t, node - inner]
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-12
    assert ((scores > 0.5) == (y == 1)).mean() > 0.95


def chained(values, form):
    """Spark's xxhash64 of several numbers: each one's hash is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack(form, v), seed=seed)
    return seed


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def minhash(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in text.lower().split()]
    if not words:
        return ""
    parts = [words[i : i + 5] for i in range(len(words) - 4)]
    assert parts, "texts of five words or more"
    filled = {}
    for p in parts:
        h = chained(p, "<q") & ((1 << 63) - 1)
        bin_ = h >> 56
        filled[bin_] = min(h, filled.get(bin_, h))
    out = []
    for j in range(128):
        tries = [chained((j, t), "<i") & 127 for t in range(1, 9)]
        start, stride = chained((j, 0), "<i") & 0xFFFF, (chained((0, j), "<i") | 1) & 0xFFFF
        tries += [(start + t * stride) & 127 for t in range(1, 129)]
        at = j if j in filled else next(t for t in tries if t in filled)
        out.append(f"{filled[at] & 255:02x}")
    return "".join(out)


def test_fingerprints_bin_by_bin(spark):
    r = np.random.default_rng(9)
    texts = [" ".join(r.choice(["alpha", "Beta", "gamma", "delta", "x1", "y,"], n)) for n in (5, 6, 9, 40, 300, 3000)] + ["", "  \n "]
    rows = fingerprint.fingerprint(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.fingerprint for r in rows} == {t: minhash(t) for t in texts}
