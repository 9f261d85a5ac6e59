"""Language models: FTRL against a plain loop, scores against a plain mean, columns with clashing names."""

import numpy as np
from pyspark.sql import functions as F

from sparkveil.llm import langid


def plain_ftrl(at, share, y, idf, k, alpha=2.0, beta=1.0, l1=2e-5, l2=1e-5, epochs=6, batch=32):
    """One feature and one class at a time."""
    z, n, w = {}, {}, {}
    bias = langid.BUCKETS
    for _ in range(epochs):
        for lo in range(0, len(at), batch):
            grad = {}
            rows = range(lo, min(lo + batch, len(at)))
            for r in rows:
                x = {int(a): float(s) * idf[a] for a, s in zip(at[r], share[r])} | {bias: 1.0}
                logit = [sum(v * w.get((f, c), 0.0) for f, v in x.items()) for c in range(k)]
                e = [np.exp(v - max(logit)) for v in logit]
                for c in range(k):
                    slip = e[c] / sum(e) - (y[r] == c)
                    for f, v in x.items():
                        if v:
                            grad[f, c] = grad.get((f, c), 0.0) + v * slip / len(rows)
            for key, g in grad.items():
                old = n.get(key, 0.0)
                sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / alpha
                z[key] = z.get(key, 0.0) + g - sigma * w.get(key, 0.0)
                n[key] = old + g * g
                edge = 0.0 if key[0] == bias else l1
                w[key] = 0.0 if abs(z[key]) <= edge else -(z[key] - np.sign(z[key]) * edge) / ((beta * 1e-3 + np.sqrt(n[key])) / alpha + l2)
    return w


def test_ftrl_like_a_plain_loop():
    r = np.random.default_rng(4)
    at = [np.sort(r.choice(40, 6, replace=False)) for _ in range(70)]
    share = [np.full(6, 1 / 6, np.float32) for _ in at]
    y = np.array([int(a[0] > 5) + int(a[0] > 9) for a in at])
    idf = r.uniform(0.5, 2, langid.BUCKETS)
    weights, bias = langid.ftrl(at, share, y, idf, 3, epochs=2)
    expected = plain_ftrl(at, share, y, idf, 3, epochs=2)
    for (f, c), v in expected.items():
        assert abs((bias[c] if f == langid.BUCKETS else weights[f, c]) - v) < 1e-6


def test_logits_are_the_mean_over_ngrams():
    table = np.random.default_rng(5).normal(size=(langid.BUCKETS, 3))
    model = langid.Model(["a", "b", "c"], table, np.array([0.1, 0.2, 0.3]))
    for text in ("", "x", "Some words, again some words", "é漢" * 50):
        g = langid.ngrams(text)
        mean = sum((table[i] for i in g), np.zeros(3)) / max(1, len(g))
        assert np.allclose(model.logits(text), model.bias + mean)


def test_clashing_columns(spark, docs):
    model = langid.train(docs)
    odd = docs.withColumns({c: F.lit(c) for c in ("said", "SAID_", "_said", "lang_pred", "a.b", "d", "_w")})
    rows = langid.predict(odd, model).collect()
    assert all((r.said, r["SAID_"], r._said, r["a.b"]) == ("said", "SAID_", "_said", "a.b") for r in rows) and rows[0].lang_pred != "lang_pred"
