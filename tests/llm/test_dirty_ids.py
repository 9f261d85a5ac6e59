"""Near copies among rows that share a doc_id or have none."""

import corpus_pipeline


def test_only_linked_rows_are_dropped(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue"))
    rows = [(1, a), (1, b), (2, b), (2, b), (None, None), (None, None), (3, ""), (3, ""), (None, a)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (None, None), (None, None), (3, ""), (3, "")], key=str)
