"""Operator 4, quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes the statistics named in ``FEATURES``. Trees are grown level by level on
quantile histograms of the statistics with the logistic loss, then flattened into arrays of
features, thresholds and leaf values; scoring moves all documents of a batch down all trees at
once with numpy.

The trees are fitted on at most about ``MAX_ROWS`` labelled documents, chosen by a hash of id
and text, repeated rows once. Scoring covers every whole text.

Cases: null and empty texts have the statistics of an empty text and are scored like any other;
without labelled rows every score is 0.5, with one class only the scores are near that class;
several labels of one document are averaged and rounded up; labels that are null or have no
document teach nothing; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

MAX_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes lower upper digit space newline mark symbol high log_words word_length distinct_words top_word "
    "distinct_pairs symbol_words lines distinct_lines line_length marked_lines zipf"
).split()


def _classes() -> np.ndarray:
    """256 x 8 membership of bytes in the character classes, in the order of FEATURES."""
    out = np.zeros((256, 8))
    groups = [range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"-()", b"", range(128, 256)]
    for i, g in enumerate(groups):
        out[list(g), i] = 1
    out[out.sum(axis=1) == 0, 6] = 1
    return out


_CLASSES = _classes()
_SYMBOLS = frozenset("|$%*&#<>{}[]@=+_/~^\\`")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = (np.bincount(raw, minlength=256) @ _CLASSES / max(1, len(raw))).tolist()
    words = text.split()
    n = len(words)
    if n:
        seen = Counter(words)
        of_words = [
            np.log1p(n), sum(map(len, words)) / n, len(seen) / n, max(seen.values()) / n,
            len(set(zip(words, words[1:]))) / max(1, n - 1), sum(c for w, c in seen.items() if w[-1] in _SYMBOLS) / n,
        ]
        once = sum(c == 1 for c in seen.values()) / n
    else:
        of_words, once = [0.0] * 6, 0.0
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    of_lines = [len(lines) / max(1, n), len(set(lines)) / k, np.log1p(len(text) / k), sum(x[-1] in ".!?:;\"'" for x in lines) / k]
    return [np.log1p(len(raw)), *shares, *of_words, *of_lines, once]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """All trees as flat arrays; node i of a tree has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right where the statistic is greater
    leaf: np.ndarray  # trees x leaves
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if not len(self.leaf) or not len(x):
            return total
        inner = self.feature.shape[1]
        tree = np.arange(len(self.leaf))[None, :]
        at = np.zeros((len(x), len(self.leaf)), np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(inner.bit_length()):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.cut[tree, at])
        return total + self.leaf[tree, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 0.5, least: float = 0.2) -> Trees:
    """Boosted trees of the logistic loss on binned statistics."""
    if not len(y):
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), 0.0)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(p0 / (1 - p0)))
    raw, inner = np.full(len(y), start), (1 << depth) - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), int)
        for level in range(depth):
            k = 1 << level
            best = np.full(k, 1e-9)
            pick, where = np.zeros(k, int), np.full(k, bins)
            gs, hs = np.bincount(node, g, k), np.bincount(node, h, k)
            for j in range(d):
                key = node * bins + binned[:, j]
                gl = np.bincount(key, g, k * bins).reshape(k, bins).cumsum(axis=1)
                hl = np.bincount(key, h, k * bins).reshape(k, bins).cumsum(axis=1)
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gs**2 / (hs + l2))[:, None]
                gain[(hl < least) | (hr < least)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(k), at] > best
                best, pick, where = np.where(better, gain[np.arange(k), at], best), np.where(better, j, pick), np.where(better, at, where)
            base = k - 1
            for i in range(k):
                if where[i] < bins:
                    feature[t, base + i] = pick[i]
                    cut[t, base + i] = edges[pick[i]][where[i]] if where[i] < len(edges[pick[i]]) else np.inf
            node = 2 * node + (binned[np.arange(len(y)), pick[node]] > where[node])
        leaf[t] = -rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + l2)
        raw += leaf[t][node]
    return Trees(feature, cut, leaf, start)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees of ``labels.quality`` on the texts of ``docs``, from the rows outside the held-out fold."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.where(~held_out())
    total = docs.select("doc_id").join(known, "doc_id").count()
    keep = int(min(1.0, max_rows / max(1, total)) * (1 << 30))
    chosen = docs.select("doc_id", "text").where(F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) <= keep).join(known, "doc_id").distinct()

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(matrix(b["text"]))})

    rows = chosen.mapInPandas(featurise, "doc_id long, y int, x array<float>").toPandas()
    x = np.array(rows["x"].to_list(), np.float32).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["doc_id"]))  # the same trees for any order of arrival
    return fit(x[order], rows["y"].to_numpy(float)[order])


def score(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(matrix(texts)))

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*keep, run(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
