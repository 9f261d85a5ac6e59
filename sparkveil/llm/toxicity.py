"""Operator 13, toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, everything but letters and digits becomes one space, and a space stands before
and behind it. Its features are the distinct character n-grams of ``ORDERS`` that belong to the
vocabulary, present or absent. Training takes three steps:

1. vocabulary: the ``VOCABULARY`` n-grams whose presence goes most with the label (chi-square), from at
   most about ``VOCABULARY_ROWS`` texts of each class;
2. log-count ratios: the documents of either class that hold each n-gram, counted over every labelled
   training text, smoothed by one, as the logarithm of the ratio of their shares;
3. weights: logistic regression on presence times ratio, by AdaGrad with an L2 penalty, from at most
   about ``MAX_ROWS`` texts of each class; the intercept is then moved by the classes' share in the draw.

Samples are drawn by a hash of id and text, so that the same rows give the same model.

Cases: null, empty and wordless texts hold no feature and get the score of the intercept; without
labelled rows every score is 0.5; with one class only the scores are near that class; several labels of
one document are averaged and rounded up; labels that are null or have no document teach nothing;
repeated rows are kept, each with the same score; texts of any length are read whole, ``CHUNK`` code
points at a time; ties between n-grams of equal chi-square go to the least hash; columns of any name are
kept, but for ``score`` and ``predicted``, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

ORDERS = (4, 6, 8)
VOCABULARY = 8192  # places fit 16 bits
VOCABULARY_ROWS = 1500
MAX_ROWS = 5000
THRESHOLD = 0.3
FOLDS, HELD = 4, 2
CHUNK = 1 << 20

_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's text leaves the remainder 2 of 4; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def hashes(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of all n-grams of the text, in pieces."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.concatenate([[False], _letters()[points], [False]])
    kept = np.concatenate([[True], word[1:] | word[:-1]])  # a gap's first character stands for all of it
    kept[1] &= bool(word[1])
    plain = np.where(word, np.concatenate([[32], points, [32]]), 32)[kept].astype(np.uint64)
    longest = ORDERS[-1]
    for lo in range(0, len(plain), CHUNK):
        part = plain[lo : lo + CHUNK + longest - 1]
        h = part
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            h = h[:-1] * _STEP + part[n - 1 :]
            if n in ORDERS:
                yield (h[:CHUNK] + np.uint64(n)) * _SPREAD


def distinct(text: str | None) -> np.ndarray:
    found = [np.unique(h) for h in hashes(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


class Vocabulary:
    """Finds the features of a text: a bit filter first, then a binary search among the hashes."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.astype(np.uint64))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.grams)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _FILTER_BITS)).view(np.int64)

    def hits(self, text: str | None) -> np.ndarray:
        """Sorted places in the vocabulary of the n-grams that the text holds."""
        seen = np.zeros(len(self.grams), bool)
        if len(self.grams):
            for h in hashes(text):
                h = h[self.filter[self._slot(h)]]
                at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
                seen[at[self.grams[at] == h]] = True
        return np.flatnonzero(seen).astype(np.int16)


@dataclass
class Model:
    grams: np.ndarray  # sorted hashes
    ratio: np.ndarray  # log-count ratio of each
    weight: np.ndarray  # of presence times ratio
    bias: float = 0.0

    def score(self, hits: np.ndarray) -> float:
        z = self.bias + float(self.ratio[hits] @ self.weight[hits])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _labelled(labels: DataFrame) -> DataFrame:
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    return known.where(~held_out())


def _drawn(docs: DataFrame, known: DataFrame, sizes: dict[int, int], rows: int, seed: int) -> DataFrame:
    """(doc_id, text, y) of about ``rows`` texts of each class; repeated rows once."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    limit = {y: int(min(1.0, rows / max(1, n)) * (1 << 30)) for y, n in sizes.items()}
    # the larger of the two limits first, so that only these texts are shuffled
    few = docs.where(draw < max(limit.values(), default=0)).withColumn("draw", draw)
    wanted = F.when(F.col("y") == 1, limit.get(1, 0)).otherwise(limit.get(0, 0))
    return few.join(known, "doc_id").where(F.col("draw") < wanted).select("doc_id", "text", "y").distinct()


def vocabulary(sample: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Hashes of the ``size`` n-grams of ``sample`` (text, y) whose presence goes most with y."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, n, n1 = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for lo in range(0, len(b), 64):
                rows = [distinct(t) for t in b["text"].iloc[lo : lo + 64]]
                ys = np.repeat(b["y"].to_numpy(np.int64)[lo : lo + 64], [len(r) for r in rows])
                grams, at = np.unique(np.concatenate([grams, *rows]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, np.ones(len(ys))]), len(grams)).astype(np.int64)
                n1 = np.bincount(at, np.concatenate([n1, ys]), len(grams)).astype(np.int64)
        yield pd.DataFrame({"gram": grams.view(np.int64), "n": n, "n1": n1})

    total, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < total:
        return np.zeros(0, np.uint64)
    sums = sample.select("text", "y").mapInPandas(count, "gram long, n long, n1 long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    a, b = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    c, d = ones - a, (total - ones) - b
    chi = total * (a * d - b * c) ** 2 / (F.col("n") * (total - F.col("n")) * float(ones) * float(total - ones))
    best = sums.where(F.col("n") < total).withColumn("chi", chi).orderBy(F.desc("chi"), "gram").limit(size)
    return np.sort(np.array([r["gram"] for r in best.select("gram").collect()], np.int64).view(np.uint64))


def with_hits(docs: DataFrame, grams: np.ndarray) -> DataFrame:
    """(doc_id, draw, hits) of every text: which n-grams of the vocabulary it holds."""
    words = docs.sparkSession.sparkContext.broadcast(grams)

    @F.pandas_udf("array<smallint>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Vocabulary(words.value)
        for texts in batches:
            yield pd.Series([known.hits(t) for t in texts], dtype=object)

    return docs.select("doc_id", F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(1 << 30)).alias("draw"), find("text").alias("hits"))


def ratios(rows: DataFrame, n_grams: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratio of each n-gram, rows of class 0 and 1) over all ``rows`` (hits, y)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, n_grams + 1), np.int64)  # the last counts the rows
        for b in batches:
            for hits, y in zip(b["hits"], b["y"], strict=True):
                n[y, hits] += 1
                n[y, -1] += 1
        y, at = np.nonzero(n)
        yield pd.DataFrame({"y": y.astype(np.int32), "gram": at.astype(np.int32), "n": n[y, at]})

    n = np.zeros((2, n_grams + 1), np.int64)
    for r in rows.select("hits", "y").mapInPandas(count, "y int, gram int, n long").groupBy("y", "gram").agg(F.sum("n").alias("n")).collect():
        n[r["y"], r["gram"]] = r["n"]
    share = (n[:, :-1] + 1) / (n[:, -1:] + 2)
    return np.log(share[1] / share[0]), n[:, -1]


def fit(hits: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression, by AdaGrad over shuffled batches."""
    w, bias, grown, grown_b = np.zeros(len(ratio)), 0.0, np.full(len(ratio), 1e-6), 1e-6
    order = np.random.default_rng(17)
    for _ in range(epochs):
        shuffled = order.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = shuffled[lo : lo + batch]
            sizes = [len(hits[r]) for r in rows]
            at, of = np.concatenate([hits[r] for r in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
            z = bias + np.bincount(of, w[at] * ratio[at], len(rows))
            slip = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[rows]) / len(rows)
            g = np.bincount(at, slip[of] * ratio[at], len(ratio)) + l2 * w
            grown += g * g
            w -= rate * g / np.sqrt(grown)
            grown_b += slip.sum() ** 2
            bias -= rate * slip.sum() / np.sqrt(grown_b)
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, vocabulary_rows: int = VOCABULARY_ROWS) -> Model:
    """A model of ``labels.toxic`` on the texts of ``docs``, from the rows outside the held-out fold."""
    docs, known = docs.select("doc_id", "text"), _labelled(labels)
    sizes = {r["y"]: r["count"] for r in docs.select("doc_id").join(known, "doc_id").groupBy("y").count().collect()}
    if not sizes:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    grams = vocabulary(_drawn(docs, known, sizes, vocabulary_rows, 29))
    rows = materialize(with_hits(docs, grams).join(known, "doc_id"), "toxicity-rows")
    ratio, n = ratios(rows, len(grams))
    limit = [int(min(1.0, max_rows / max(1, k)) * (1 << 30)) for k in n]
    wanted = F.when(F.col("y") == 1, limit[1]).otherwise(limit[0])
    drawn = rows.where(F.col("draw") < wanted).select("doc_id", "y", "hits").distinct().toPandas()
    drawn["held"] = [np.asarray(x, np.int16).tobytes() for x in drawn["hits"]]
    drawn = drawn.sort_values(["doc_id", "held"]).reset_index(drop=True)  # the same weights for any order of arrival
    drop_table(rows)
    y = drawn["y"].to_numpy(float)
    if not 0 < n[1] < n.sum():
        p = (n[1] + 0.5) / (n.sum() + 1)
        return Model(grams, ratio, np.zeros(len(grams)), float(np.log(p / (1 - p))))
    weight, bias = fit([np.asarray(x, np.int16) for x in drawn["hits"]], y, ratio)
    moved = np.log((n[1] + 1) / (n[0] + 1)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return Model(grams, ratio, weight, bias + float(moved))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        known = Vocabulary(m.grams)
        for texts in batches:
            yield pd.Series([m.score(known.hits(t)) for t in texts], dtype="float64")

    keep = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*keep, run(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
