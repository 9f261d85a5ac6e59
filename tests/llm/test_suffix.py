"""The suffix sort against brute force: planted passages, split groups, periodic texts and colliding hashes."""

import random

import brute
import numpy as np
import pytest
from conftest import prose

from sparkveil.llm import suffix


def compare(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed_spans)) for r in suffix.remove(frame, **how).collect()}
    assert got == {d: x[:3] for d, x in brute.repeated(rows, how.get("length", 400)).items()}
    return got


def planted(size, copies, seed, lead=300):
    body = prose(seed, size)[:size]
    return [prose(seed * 100 + k, 10 + lead // 5 + k % 9) + chr(113 + k % 10) + body + chr(113 + k % 10) + prose(seed * 100 + 50 + k, 70) for k in range(copies)]


def test_planted_passages(spark):
    texts = [t for k, size in enumerate((300, 399, 400, 401, 600)) for t in planted(size, 3, 10 + k)]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    got = compare(spark, rows)
    assert [got[3 * k][1] for k in range(5)] == [0, 0, 400, 401, 600]


def test_both_lengths(spark):
    rows = list(enumerate(t for k, size in enumerate((200, 249, 250, 330, 399, 500)) for t in planted(size, 2, 20 + k)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.passage_bytes) for r in suffix.remove(frame, passage=250).collect()}
    want = {d: (x[1], brute.repeated(rows, 250)[d][1]) for d, x in brute.repeated(rows).items()}
    assert got == want and [got[2 * k] for k in range(6)] == [(0, 0), (0, 0), (0, 250), (0, 330), (0, 399), (500, 500)]


@pytest.mark.parametrize("size", [90, 99, 130])
def test_large_group_is_split(spark, size):
    rows = list(enumerate(planted(size, 150, 31, lead=40) + [prose(7, 60)] * 3 + planted(250, 40, 32, lead=20)))
    compare(spark, rows, length=100, group_rows=8)


def test_periodic_and_copied_texts(spark):
    r = random.Random(5)
    base = prose(41, 200)
    rows = [(0, "la " * 900), (1, "la " * 400), (2, "ab" * 700 + base), (3, base), (4, base), (5, "x" * 400), (6, "x" * 399)]
    for k in range(40):
        words = base.split()
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = prose(r.randrange(99), 1)
        rows.append((10 + k, " ".join(words)))
    compare(spark, rows)
    compare(spark, rows, length=60, group_rows=5)


def test_collisions_are_found(monkeypatch):
    monkeypatch.setattr(suffix, "slice_hash", lambda h, a, b: np.zeros(len(a), np.uint64))  # every comparison collides
    segments = [b"abcdefgh", b"abcdefgz", b"abcdeqgh"]
    x, lo, hi = suffix.repeated_windows(segments, np.zeros(3, np.int64), np.array([2, 2, 2]), np.zeros(3, np.int64), np.full(3, 2), 5)
    assert sorted(zip(x.tolist(), lo.tolist(), hi.tolist())) == [(0, 0, 2), (1, 0, 2), (2, 2, 2)]


def test_columns_go_through(spark):
    frame = spark.createDataFrame([(1, "a", "mine", "r", 7), (None, None, None, None, None)], "doc_id long, text string, `row` string, runs string, n_removed int")
    out = suffix.remove(frame)
    assert out.columns == ["doc_id", "text", "row", "runs", "kept_text", "n_bytes", "n_removed", "removed_spans", "passage_bytes"]
    assert {(r.doc_id, r["row"], r.runs, r.n_removed) for r in out.collect()} == {(1, "mine", "r", 0), (None, None, None, 0)}


def test_characters_go_whole():
    assert suffix.without_spans("aébcé漢z", [{"lo": 2, "hi": 4}, {"lo": 5, "hi": 7}]) == "ac漢z"
    assert suffix.without_spans("ééé", [{"lo": 1, "hi": 3}]) == "é" and suffix.without_spans("abc", []) == "abc"
