"""Ordered scans of journals in time slices against a plain loop, with one module that has nearly all rows."""

import random

import pytest

from sparkveil.operators import aggregates as a


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = []
    for seq in range(1200):
        module = r.choice(["hot"] * 9 + ["cold", None])
        out.append((seq, r.choice([r.randint(0, 400), r.randint(0, 90_000)]), r.choice(["poll.ok", "poll.error", "poll.error", "log"]), module, f"failed {r.choice('abcdef')} {seq}"))
    return out


@pytest.fixture(scope="module")
def journal(spark, rows):
    return spark.createDataFrame(rows, "seq long, t long, kind string, module string, message string").cache()


def by_module(rows):
    out = {}
    for x in sorted(rows, key=lambda x: (x[1], x[0])):
        out.setdefault(x[3], []).append(x)
    return out


@pytest.mark.parametrize("slice_s", [1, 60, 3600, 10**9])
def test_scans_by_slices(journal, rows, slice_s):
    groups = by_module(rows)
    segments = {}
    for xs in groups.values():
        n = 0
        for x in xs:
            n += x[0] % 50 == 0
            segments[x[0]] = n
    assert {r.seq: r.segment for r in a.segments(journal, "seq % 50 = 0", slice_s).collect()} == segments
    stalls, gaps, ends = {}, {}, set()
    for module, xs in groups.items():
        for i, x in enumerate(xs):
            if x[2] == "poll.error":
                stalls[x[0]] = next((y[1] for y in xs[i + 1 :] if y[2] == "poll.ok"), None)
        good = [x[1] for x in xs if x[2] == "poll.ok"] + [100_000]
        gaps[module] = max((q - p, -q) for p, q in zip(good, good[1:]))
        ends |= {x[0] for x in xs[:20] + xs[-30:]}
    assert {r.seq: r.recovered for r in a.stalls(journal, slice_s).collect()} == stalls
    assert {r.module: (r.gap, -r.until) for r in a.longest_gaps(journal, 100_000, slice_s).collect()} == gaps
    found = a.timeline(journal, 20, 30, slice_s).collect()
    assert {r.seq for r in found} == ends and len(found) == len(ends)


def test_error_groups_beyond_the_limit(journal, rows):
    counts = {}
    for x in rows:
        if x[2] == "poll.error":
            counts.setdefault(x[3], {}).setdefault(f"failed {x[4].split()[1]} <n>", []).append(x[1])
    expected = {}
    for module, groups in counts.items():
        for place, (message, ts) in enumerate(sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))):
            expected.setdefault((module, message if place < 4 else "(other)"), []).extend(ts)
    for parts in (1, 3, 32):
        got = {(r.module, r.message): (r.n, r.first_t, r.last_t) for r in a.error_groups(journal, 4, parts).collect()}
        assert got == {k: (len(ts), min(ts), max(ts)) for k, ts in expected.items()}
