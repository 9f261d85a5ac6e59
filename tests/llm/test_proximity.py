"""Span queries of the positional index against every document's words."""

import random

import brute
from pyspark.sql import functions as F

from sparkveil.llm import decontam

SPAN = 20


def words(text):
    return brute.ALNUM.findall((text or "").encode().translate(brute.LOWER))


def test_proximity_brute(spark):
    r = random.Random(5)
    filler = [f"w{i}" for i in range(12)]
    items = [(f"i{k}", " ".join([f"rare{k}", *r.choices(filler, k=9), f"odd{k}", *r.choices(filler, k=3)])) for k in range(6)] + [("short", "lone pair"), ("none", "")]
    docs = [(0, None), (1, ""), (2, "lone " * 40 + "pair"), (3, "rare0")]
    for n, gap in enumerate((0, 1, SPAN - 2, SPAN - 1, SPAN, 2 * SPAN)):  # words between the two
        for k in range(6):
            pair = [f"rare{k}", f"odd{k}"] if (n + k) % 2 else [f"Odd{k}", f"RARE{k}"]
            docs.append((10 * n + k + 10, " ".join([*r.choices(filler, k=r.randrange(60)), pair[0], *r.choices(filler, k=gap), pair[1], *r.choices(filler, k=r.randrange(30))])))
    docs += [(100, docs[10][1]), (101, docs[20][1] + " " + docs[11][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    held = decontam.item_words(b)
    windows = decontam.pick_rarest(held, decontam.corpus_frequencies(d, held.select(F.explode("words").alias("term")).distinct()))
    index = decontam.build_index(d, held.select(F.explode("words").alias("term")).distinct())
    keys = d.withColumn("doc", decontam._row_key())
    got = {(x.doc_id, x.item_id) for x in decontam.proximity(index, held, windows, SPAN).join(keys, "doc").join(held.select("item", "item_id"), "item").collect()}
    picked = {x.item_id: x.windows for x in windows.join(held.select("item", "item_id"), "item").collect()}
    want, by_id = set(), dict(items)
    for doc, text in docs:
        w = words(text)
        for item, chosen in picked.items():
            terms = [{words(by_id[item])[a] for a in ats} for ats in chosen]
            if any(t <= set(w[s : s + SPAN]) for t in terms for s in range(len(w))):
                want.add((doc, item))
    assert got == want and 0 < len(want) < len(docs) * len(picked)
    assert (2, "short") in want and (3, "i0") not in want
    assert decontam.proximity(index.limit(0), held, windows, SPAN).count() == 0
