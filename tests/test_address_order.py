"""The place of every address in the whole table."""

import random

from sparkveil.operators import matching


def test_address_order_of_all_rows(spark):
    random.seed(1)
    rows = [(t, str(n), n) for t in range(2000) for n in [random.choice([7, 7, random.randrange(1 << 32)])]]
    want = {t: i + 1 for i, (t, _, _) in enumerate(sorted(rows, key=lambda x: (x[2], x[0])))}
    got = matching.address_order(spark.createDataFrame(rows, "target long, ip string, ip_num long"), 8).collect()
    assert {r.target: r.place for r in got} == want and [r.place for r in got] == list(range(1, 2001))
    assert matching.address_order(spark.createDataFrame([], "target long, ip string, ip_num long")).count() == 0
