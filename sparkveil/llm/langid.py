"""Operator 1, language identification.

Features are hashed character n-grams (1 to 3 code points of the lower-cased text) weighted by
TF-IDF: a document's weight of a feature is its share of the document's n-grams times the
feature's inverse document frequency, counted over every training document. A multinomial
logistic regression is fitted by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties, which leaves most weights at exactly zero; a temperature fitted on a slice of the
sample that the weights haven't seen then calibrates the probabilities.

The weights are fitted on about ``PER_LANG`` documents of each of the ``MAX_LANGS`` most frequent
languages (ties by name), chosen by a hash of id and text, repeated rows once; document frequencies and language counts cover all training documents. Prediction
reads whole texts.

Cases: ``und`` with score 0.0 for a null text or one without a letter, and for all rows when
there is nothing to learn from; a single learned language is predicted with the score it gets
(1.0); ties between languages go to the first by name; repeated rows are kept; a text of any length takes room
for its n-grams and one count a bucket; columns of any name are kept, but for ``lang_pred`` and ``score``, which are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
PER_LANG = 800
MAX_LANGS = 256


def ngrams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of the text, one entry for each occurrence."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        if len(cp) < n:
            break
        h = np.full(len(cp) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ cp[k : len(cp) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs: weight times inverse document frequency
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        g = ngrams(text)
        return self.bias + (np.bincount(g, minlength=BUCKETS) @ self.table / len(g) if len(g) else 0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Number of documents that hold each bucket, over all rows of ``texts``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                seen = np.zeros(BUCKETS, bool)
                seen[ngrams(text)] = True
                df += seen
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": df[at]})

    rows = texts.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    return out


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [np.unique(ngrams(t), return_counts=True) for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "lang": batch["lang"],
            "at": [r[0].astype(np.int32) for r in rows],
            "share": [(r[1] / max(1, r[1].sum())).astype(np.float32) for r in rows],
        })


def train(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model of ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing."""
    usable = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    usable, n_docs = usable.where(F.col("lang").isin(langs)), sum(counts.values())
    idf = np.log((1 + n_docs) / (1 + document_frequencies(usable)))
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, per_lang / counts[k]) * (1 << 30)))])
    sample = usable.where(draw <= limit[F.col("lang")]).distinct().mapInPandas(_features, "doc_id long, lang string, at array<int>, share array<float>")
    rows = sample.toPandas()
    rows["held"] = [np.asarray(x, np.int32).tobytes() for x in rows["at"]]  # one order for rows of one id
    rows = rows.sort_values(["doc_id", "lang", "held"]).sample(frac=1, random_state=11).reset_index(drop=True)
    at, share = [np.asarray(x, np.int64) for x in rows["at"]], [np.asarray(x, np.float32) for x in rows["share"]]
    y = rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    cut = max(1, len(rows) * 4 // 5)
    weights, bias = ftrl(at[:cut], share[:cut], y[:cut], idf, len(langs))
    model = Model(langs, (weights * idf[:, None]).astype(np.float32), bias)
    z = np.array([bias + (s[:, None] * model.table[a]).sum(axis=0) for a, s in zip(at[cut:], share[cut:], strict=True)])
    if len(z):
        model.temperature = fit_temperature(z, y[cut:])
    return model


def ftrl(at: list, share: list, y: np.ndarray, idf: np.ndarray, k: int, alpha=2.0, beta=1.0, l1=2e-5, l2=1e-5, epochs=6, batch=32) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over mini-batches; the last row of its state is the bias, without penalty."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    w = np.zeros((BUCKETS + 1, k))
    for _ in range(epochs):
        for lo in range(0, len(at), batch):
            rows = range(lo, min(lo + batch, len(at)))
            x = np.zeros((len(rows), BUCKETS + 1))
            for i, r in enumerate(rows):
                x[i, at[r]] = share[r] * idf[at[r]]
            x[:, -1] = 1.0
            used = np.flatnonzero(x.any(axis=0))
            xs = x[:, used]
            p = softmax(xs @ w[used])
            p[np.arange(len(rows)), y[lo : lo + len(rows)]] -= 1
            g = xs.T @ p / len(rows)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w[used]
            n[used] += g * g
            keep1 = np.where(used == BUCKETS, 0.0, l1)[:, None]
            zs = z[used]
            w[used] = np.where(np.abs(zs) <= keep1, 0.0, -(zs - np.sign(zs) * keep1) / ((beta * 1e-3 + np.sqrt(n[used])) / alpha + l2))
    return w[:-1], w[-1]


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    keep = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")]
    said = fresh(docs, "said")
    return docs.withColumn(said, run(F.col(text))).select(*keep, f"{said}.lang_pred", f"{said}.score")
