"""The kept index against a plain scan of the documents, over batches of changes and deletions."""

import random

from sparkveil.operators.kept_index import DOCUMENT, KeptIndex

COLUMNS = ", ".join(DOCUMENT.split(", ")[:-2])


def scan(docs, queries, limit=20):
    """{(qid, id): (score, place)} by looking at every document."""
    out = {}
    for qid, q, types, layers in queries:
        q = (q or "").strip().lower()
        hits = []
        for i, kind, layer, value, label, aliases, degree, seen in docs:
            hay = [x.lower() for x in (value, label, *(aliases or [])) if x]
            if not q or (types and kind not in types) or (layers and layer not in layers):
                continue
            score = 1.0 if q in hay else 0.8 if any(h.startswith(q) for h in hay) else 0.5 if any(q in h for h in hay) else 0
            if score:
                hits.append((-score, -(degree or 0), -(seen or 0), i))
        for place, (s, _, _, i) in enumerate(sorted(hits)[:limit]):
            out[qid, i] = (-s, place + 1)
    return out


def some(r, i):
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    return (i, r.choice(["ip", "domain"]), r.choice(["x", "y", None]), word(), r.choice([None, "", word() + " " + word()]), r.choice([None, [], [word(), word()], [None, word()]]), r.randint(0, 3), r.randint(0, 3))


def test_index_like_a_scan(spark, tmp_path):
    r = random.Random(2)
    index, now = KeptIndex(spark, f"file://{tmp_path}/i", 8), {}
    queries = [(k, q, t, y) for k, (q, t, y) in enumerate([("a", None, None), ("ab", ["ip"], None), ("ABC", None, ["x", "y"]), ("bca", [], []), ("zzz", None, None), ("", None, None), (None, None, None), (" c", ["none"], None), ("é", None, ["x"]), ("abca", None, None), ("a b", None, None)])]
    asked = spark.createDataFrame(queries, "qid long, q string, types array<string>, layers array<string>")
    for batch in range(3):
        new = [some(r, i) for i in r.sample(range(60), 25)]
        gone = r.sample(range(60), 6)
        index.add(spark.createDataFrame(new, COLUMNS), batch, spark.createDataFrame([(i,) for i in gone], "id long"))
        for i in gone:
            now.pop(i, None)
        now |= {d[0]: d for d in new}
        found = {(x.qid, x.id): (x.score, x.place) for x in index.search(asked).collect()}
        assert found == scan(list(now.values()), queries)


def test_small_batches_leave_buckets_alone(spark, tmp_path):
    index = KeptIndex(spark, f"file://{tmp_path}/i", 64)
    row = lambda i, v: (i, "ip", None, v, None, None, 0, 0)
    index.add(spark.createDataFrame([row(i, f"{i * 7919 % 100003:05d}") for i in range(300)], COLUMNS), 0)
    index.add(spark.createDataFrame([row(1000, "qq")], COLUMNS), 1)
    assert sorted(index.postings.committed().values()).count(1) <= 2 and list(index.documents.committed().values()).count(1) == 1
    index.add(spark.createDataFrame([row(1000, "qq")], COLUMNS), 1)  # again: nothing
    asked = spark.createDataFrame([(1, "qq", None, None)], "qid long, q string, types array<string>, layers array<string>")
    assert [(x.id, x.score) for x in index.search(asked).collect()] == [(1000, 1.0)]
    index.add(spark.createDataFrame([], COLUMNS), 2, spark.createDataFrame([(1000,)], "id long"))
    assert index.search(asked).count() == 0
