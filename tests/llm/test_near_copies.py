"""Large groups of near copies: linked with a base, with each other, or all just below the threshold."""

import random

import brute
import pytest
from conftest import prose

from sparkveil.llm import jaccard


def joined(spark, rows):
    return {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def copies(n, changed, seed):
    """``n`` copies of 150 words with ``changed`` words replaced in each, beside other documents."""
    r, base = random.Random(seed), prose(11, 150).split()
    rows = []
    for i in range(n):
        words = list(base)
        for at in r.sample(range(150), changed):
            words[at] = "w%d" % r.randrange(10**6)
        rows.append((i, " ".join(words)))
    return rows + [(10**6 + i, prose(100 + i, 60)) for i in range(100)]


def test_group_of_near_copies(spark):
    r = random.Random(7)
    base = prose(11, 150).split()
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            words[r.randrange(len(words))] = "w%d" % r.randrange(40)
        del words[: r.choice([0, 0, 5, 20])]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(50 + i, 100)) for i in range(20)]
    r.shuffle(rows)
    assert joined(spark, rows) == brute.jaccard(rows)


@pytest.mark.parametrize("changed", [1, 2, 3, 4])
def test_copies_around_the_threshold(spark, changed):
    rows = copies(150, changed, changed)
    assert joined(spark, rows) == brute.jaccard(rows)


def test_short_and_repetitive_sets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(1, 40)))) for i in range(250)]
    assert joined(spark, rows) == brute.jaccard(rows)


def test_few_pairs_meet_below_the_threshold(spark, monkeypatch):
    """The pairs that meet are a small part of a group's pairs: copies of which 3 words differ are nearly all too far apart."""
    met = []
    whole = jaccard.meetings
    monkeypatch.setattr(jaccard, "meetings", lambda *a: met.append(whole(*a)) or met[-1])
    monkeypatch.setattr(jaccard, "drop_table", lambda x: None)
    joined(spark, copies(500, 3, 1))
    assert met[0].count() < 0.15 * 500 * 499 / 2


def test_wanted_sets_need_one_python_worker_a_task(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (None, "k l m n o p"), (2, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(7, "a b c d e f", 1), (9, "k l m n o p", None)]
    wanted = spark.createDataFrame([(i, jaccard._signature(jaccard.shingles(t)), rep) for i, t, rep in want], "id long, class binary, rep long")
    found = jaccard.whole_sets(wanted, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "EvalPython" not in plan
    assert {x.id: x.tokens for x in found.collect()} == {i: jaccard.shingles(t).view("int64").tolist() for i, t, _ in want}
