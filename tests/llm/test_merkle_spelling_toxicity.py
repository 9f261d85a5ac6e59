"""Merkle manifests, spelling variants and toxicity: brute force, odd rows, held-out accuracy, a plain loop for the model."""

import hashlib
import re
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from conftest import cases
from pyspark.sql import functions as F

from sparkveil.llm import entry, merkle, spelling, toxicity

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, columns="doc_id, source, lang, n_chars, text"):
    return [tuple(r) for r in df.selectExpr(*[c.strip() for c in columns.split(",")]).collect()]


# --- Merkle ------------------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level):
    """(root, siblings left and right of every leaf, level by level)"""
    paths, of = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, at in enumerate(of):
            run, s = runs[at // 16], at % 16
            paths[k].append(("".join(run[:s]), "".join(run[s + 1 :])))
        of, level = [at // 16 for at in of], [sha("".join(r)) for r in runs]
    return level[0], paths


def manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault("0" if row[1] is None else "1" + row[1], []).append(row)
    keys = sorted(groups, key=lambda k: k.encode())
    of = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        of[k] = climb([leaf(r) for r in groups[k]])
    root, above = climb([of[k][0] for k in keys])
    out = []
    for k, up in zip(keys, above):
        for row, path in zip(groups[k], of[k][1]):
            path = path + up
            changed = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0
            h = leaf((*row[:4], row[4].translate(LOWER) if row[4] is not None and changed else row[4]))
            for left, right in path:
                h = sha(left + h + right)
            out.append((row[0], leaf(row), of[k][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def told(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


def test_manifest_brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert told(entry.QUERIES["op11_merkle_manifest"](spark, SF)) == sorted(manifest(rows_of(docs)), key=str)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_manifest_heights(spark, n):
    """Full runs, runs of one, many sources, one source."""
    for source in ("'s'", "cast(id % 3 as string)", "nullif(cast(id as string), '5')"):
        docs = spark.range(n).selectExpr("id as doc_id", f"{source} as source", "'en' as lang", "id as n_chars", "concat('Text ', id) as text")
        assert told(merkle.manifest(docs, merkle.lower_cased())) == sorted(manifest(rows_of(docs)), key=str)


def test_manifest_odd_rows(spark, docs, none):
    odd = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "É")).withColumns({c: F.lit("x") for c in ("g", "h", "t", "i", "r", "salt", "c0", "leaf", "root", "path")})
    assert told(merkle.manifest(odd, merkle.lower_cased())) == sorted(manifest(rows_of(odd)), key=str)
    assert merkle.manifest(none, merkle.lower_cased()).count() == 0
    assert all(r.verified for r in merkle.manifest(odd).collect())


def test_repeated_rows_have_their_own_proofs(spark):
    docs = spark.range(100).selectExpr("7L as doc_id", "'a' as source", "'en' as lang", "1L as n_chars", "'same' as text")
    rows = merkle.manifest(docs).collect()
    assert len(rows) == 100 and all(r.verified for r in rows) and len({r.root for r in rows}) == 1
    assert sorted(Counter(r.proof_sha256 for r in rows)) == sorted(Counter(m[4] for m in manifest(rows_of(docs))))


# --- spelling ----------------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def variants(n):
    """{word: n} -> {word: (form, root, n, n_near, form_n)}, every word against every other."""
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def grouped(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_brute(spark):
    """Texts over few letters, so that most words have neighbours, runs of equal letters and chains of forms."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(60):
        picked = r.choice(["aabba", "aaba", "aaaaa", "aaaaaa", "aaaab", "abcde", "abde", "xabcde", "ÀBcdé", "àbcdé", "abcdÉ", "bcdea"], 40)
        rows.append((i, " ".join(w if r.random() < 0.6 else w[: (k := r.integers(0, len(w)))] + "abé"[r.integers(0, 3)] + w[k + r.integers(0, 2) :] for w in picked)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = variants(words(rows))
    found = grouped(spelling.variants(docs))
    assert found == expected and any(v[0] and v[1] != v[0] for v in expected.values()) and len(expected) > 100


def test_variants_long_and_odd(spark, docs, none):
    """Runs around and far over the length from which digests stand for prefixes; the odd rows."""
    base = ["ab" * 32, "ab" * 31 + "a", "ab" * 32 + "a", "ab" * 31 + "ac", "ab" * 32 + "b", "q" * 300, "q" * 301, "q" * 299 + "r", "z" * 64, "z" * 65]
    rows = [(k, w) for k, w in enumerate(base) for _ in range(3 + 3 * k)] + [(None, "longest " * 4), (1, None), (2, "")]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    assert grouped(spelling.variants(long)) == variants(words(rows))
    odd = [(a, b) for a, b in cases() if a != 12 and a != 5 and a != 6]
    kept = docs.where("coalesce(doc_id, 0) not in (5, 6, 12)")
    assert grouped(spelling.variants(kept.withColumn("word", F.lit("w")).withColumn("prefix", F.lit("p")))) == variants(words(odd))
    assert spelling.variants(none).count() == 0


# --- toxicity ----------------------------------------------------------------------------------


def test_toxicity_ratios_and_scores(spark):
    """Log-count ratios against a loop over sets of n-grams; scores against a plain sum."""
    texts = [f"{'Blister ' if i % 3 == 0 else ''}plain words number {i} and {i % 7} more" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    held = {}
    for i in learned:
        plain = f" {re.sub('[^a-z0-9]+', ' ', texts[i].lower()).strip()} "
        held[i] = {toxicity.distinct(None).dtype.type(h) for h in toxicity.distinct(texts[i])}
        assert len(held[i]) == len({plain[k : k + n] for n in toxicity.ORDERS for k in range(len(plain) - n + 1)})
    n1, n0 = sum(i % 3 == 0 for i in learned), sum(i % 3 != 0 for i in learned)
    for g, ratio in zip(model.grams, model.ratio):
        a, b = sum(g in held[i] for i in learned if i % 3 == 0), sum(g in held[i] for i in learned if i % 3)
        assert abs(ratio - np.log(((a + 1) / (n1 + 2)) / ((b + 1) / (n0 + 2)))) < 1e-12
    place = {g: k for k, g in enumerate(model.grams)}
    rows = toxicity.score(docs, model).collect()
    for r in rows:
        z = model.bias + sum(model.ratio[place[g]] * model.weight[place[g]] for g in toxicity.distinct(r.text) if g in place)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.doc_id % 3 == 0)


def test_toxicity_pieces_of_a_long_text(monkeypatch):
    text = "One long text, read piece by piece. " * 30
    whole = set(toxicity.distinct(text).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert set(toxicity.distinct(text).tolist()) == whole


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    label = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    rows = [r for r in entry.QUERIES["op13_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in label]
    toxic = [r for r in rows if label[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted == label[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_toxicity_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (7, 1, 0), (8, None, 0), (12, 0, 1), (None, 1, 1), (99, 0, 0), (10, 0, None), (15, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    clashing = docs.withColumn("hits", F.lit(1)).withColumn("draw", F.lit(2)).withColumn("y", F.lit(3)).withColumn("a.b", F.lit(4)).withColumn("predicted", F.lit("p"))
    rows = toxicity.score(clashing, model).collect()
    assert len(rows) == len(cases()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and (r.hits, r.draw, r.y, r["a.b"]) == (1, 2, 3, 4) for r in rows)
    assert len({r.score for r in rows if not brute.shingles(r.text)}) == 1 and len({r.score for r in rows if r.doc_id == 7}) == 1
    unknown = toxicity.train(clashing, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, unknown).collect()} == {0.5} and toxicity.score(none, model).count() == 0
    clean = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, clean).collect())
