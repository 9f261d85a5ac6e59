"""The packing plan with most lengths present, as a large corpus has them."""

import numpy as np

from sparkveil.llm import packing


def test_many_lengths_reach_the_bound():
    lengths = np.clip(np.random.default_rng(0).lognormal(6, 1, 50_000).astype(int), 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    least = -(-int(lengths.sum()) // 2048)
    assert sum(n for n, _ in packing.best_fit(counts, 2048)) > least
    plan = packing.complete(counts)
    used: dict[int, int] = {}
    for n, filling in plan:
        assert sum(length * copies for length, copies in filling) <= 2048
        for length, copies in filling:
            used[length] = used.get(length, 0) + n * copies
    assert used == counts and sum(n for n, _ in plan) == least
