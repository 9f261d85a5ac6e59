"""Layer messages hold a bounded number of features, and all features are told once."""

import json

from sparkveil.operators import merges


def test_messages_are_cut(spark):
    writes = spark.range(1000).selectExpr("id % 2 as batch", "if(id % 10 = 0, 'small', 'big') as layer", "concat('f', id) as id", "id as seq", "map('v', cast(id as string)) as props")
    rows = merges.layer_deltas(writes, most=150, parts=4).collect()
    told = [(r.batch, r.layer, f["id"]) for r in rows for f in json.loads(r.message)]
    assert len(told) == len(set(told)) == 1000 and all(r.features == len(json.loads(r.message)) <= 150 for r in rows)
    assert sum(r.layer == "small" for r in rows) == 1 and sum(r.layer == "big" for r in rows) > 6  # ids of small layers all have batch 0
