"""Emissions against all earlier runs, not against a fixed part of them."""

from sparkveil.operators import states


def test_parents_in_every_earlier_run(spark):
    rows = [(1, 59, "ip", "a"), (2, 60, "ip", "a"), (3, 61, "ip", "b"), (4, 61, "ip", "b"), (5, 99, "ip", "b"), (6, 99, "ip", None), (7, 100, "ip", None)]
    df = spark.createDataFrame(rows, "seq long, run long, type string, value string")
    assert {r.seq: r.parent_seq for r in states.resolved_parents(df).collect()} == {1: None, 2: 1, 3: None, 4: None, 5: 3, 6: None, 7: 6}
    assert sorted(r.seq for r in states.first_seen(df).collect()) == [1, 3, 4, 6]
