"""Operator 5, best-fit packing by bin completion.

Documents become token pieces of at most ``CAPACITY`` ids (only longer documents are cut; the
first piece takes the remainder). What fits together depends on lengths alone, so the packing is
decided on the histogram of piece lengths, which has at most ``CAPACITY`` entries however large
the corpus is: a plan is a list of fillings, each with the number of sequences that use it.

The incumbent plan is best-fit decreasing. If it uses more sequences than the waste bound allows,
bin completion looks for a better one, first for the pieces of sequences that waste something, then
for all: around the largest piece left it enumerates undominated fillings, pruned by the waste that a
better plan can still afford, and backtracks within a bounded number of steps that grows with the
number of lengths. Every plan is whole; the bound limits only the search for a better one, and a
plan above the waste bound is logged.

Pieces are then ranked within their length (salted by a hash, so that one frequent length is
ranked by many tasks) and looked up in the plan.

Cases: null and empty texts are the single end token; repeated rows are packed one by one; an
empty table gives an empty result; ties in length go by doc_id and piece.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing
from .common import materialize, small_batches

CAPACITY = 2048
END_ID = 0
SALT_ROWS = 1_000
SEARCH_STEPS = 20_000
STEPS_A_LENGTH = 100
LOG = logging.getLogger(__name__)

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first
Plan = list[tuple[int, Filling]]  # (sequences, filling)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: equal bins are moved as groups."""
    open_bins: dict[int, list[list]] = {}  # room -> groups [sequences, filling]
    closed: Plan = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            rooms = [r for r in open_bins if r >= length]
            if not rooms:
                each = capacity // length
                bins, last = divmod(left, each)
                for n, copies in ((bins, each), (1, last)):
                    if n and copies:
                        _put(open_bins, closed, capacity - copies * length, n, ((length, copies),))
                break
            room = min(rooms)
            n, filling = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
            copies = room // length
            full, part = divmod(left, copies)
            use = min(n, full)
            if use:
                _put(open_bins, closed, room - copies * length, use, (*filling, (length, copies)))
                left -= use * copies
            if n > use and left and left < copies:
                _put(open_bins, closed, room - left * length, 1, (*filling, (length, left)))
                use, left = use + 1, 0
            if n > use:
                _put(open_bins, closed, room, n - use, filling)
    return closed + [(n, f) for groups in open_bins.values() for n, f in groups]


def _put(open_bins: dict, closed: Plan, room: int, n: int, filling: Filling) -> None:
    if room:
        open_bins.setdefault(room, []).append([n, filling])
    else:
        closed.append((n, filling))


def fillings(counts: dict[int, int], room: int, most_waste: int, budget: list[int]) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) for undominated fillings of ``room`` that waste at most ``most_waste``.

    Longer pieces are tried first. A filling is dominated where an unused piece would fit into
    what it leaves free, or could take the place of a shorter piece of it.
    """
    rising = sorted(k for k, v in counts.items() if v)

    def search(below: int, room: int, chosen: Filling) -> Iterator[tuple[int, Filling]]:
        for i in range(min(below, bisect_right(rising, room)) - 1, -1, -1):
            length = rising[i]
            budget[0] -= 1
            if budget[0] < 0:
                return
            for copies in range(min(counts[length], room // length), 0, -1):
                yield from search(i, room - copies * length, (*chosen, (length, copies)))
        if room <= most_waste and not dominated(room, dict(chosen)):
            yield room, chosen

    def dominated(room: int, used: dict[int, int]) -> bool:
        def free(above: int, most: int) -> bool:
            for i in range(bisect_right(rising, above), bisect_right(rising, most)):
                if counts[rising[i]] > used.get(rising[i], 0):
                    return True
            return False

        return free(0, room) or any(free(x, x + room) for x in used)

    return search(len(rising), room, ())


def complete(counts: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> Plan:
    """The plan with the fewest sequences that the search finds; never worse than best-fit decreasing."""
    counts = {k: v for k, v in counts.items() if v}
    least = -(-sum(k * v for k, v in counts.items()) // capacity)
    plan = best_fit(counts, capacity)
    first = bins = sum(n for n, _ in plan)
    for whole in (False, True):
        if bins > least:
            full = [] if whole else [x for x in plan if _size(x[1]) == capacity]
            plan = full + _improved([x for x in plan if whole or _size(x[1]) < capacity], capacity, steps)
            bins = sum(n for n, _ in plan)
    if bins > least:
        LOG.warning("packing: %d sequences, %d by best-fit decreasing, at least %d needed; the search ended without a better plan", bins, first, least)
    return plan


def _size(filling: Filling) -> int:
    return sum(length * copies for length, copies in filling)


def _improved(plan: Plan, capacity: int, steps: int) -> Plan:
    """``plan`` or one of fewer sequences for the same pieces, within ``steps`` and ``STEPS_A_LENGTH``."""
    counts: dict[int, int] = {}
    for n, filling in plan:
        for length, copies in filling:
            counts[length] = counts.get(length, 0) + n * copies
    total = sum(k * v for k, v in counts.items())
    budget = [steps + STEPS_A_LENGTH * len(counts)]
    while (bins := sum(n for n, _ in plan)) > -(-total // capacity) and budget[0] > 0:
        better = _branch(dict(counts), capacity, (bins - 1) * capacity - total, budget)
        if better is None:
            break
        plan = better
    return plan


def _branch(counts: dict[int, int], capacity: int, slack: int, budget: list[int], width: int = 16) -> Plan | None:
    """A plan that wastes at most ``slack`` in all, or None.

    Each level fills sequences around the longest piece left, as many at once as the counts and
    the slack allow; levels without a further option are undone.
    """
    plan: list[tuple[int, Filling, int]] = []
    levels: list[Iterator[tuple[int, Filling]]] = []
    while counts:
        if budget[0] < 0:
            return None
        first = max(counts)
        rest = counts | {first: counts[first] - 1}
        found = islice(fillings(rest, capacity - first, slack, budget), width)
        levels.append(iter(sorted((w, _joined(first, f)) for w, f in found)))
        while (option := next(levels[-1], None)) is None:
            levels.pop()
            if not levels:
                return None
            n, filling, waste = plan.pop()
            slack += n * waste
            for length, copies in filling:
                counts[length] = counts.get(length, 0) + n * copies
        waste, filling = option
        n = min([counts[x] // c for x, c in filling] + ([slack // waste] if waste else []))
        slack -= n * waste
        plan.append((n, filling, waste))
        for length, copies in filling:
            counts[length] -= n * copies
            if not counts[length]:
                del counts[length]
    return [(n, f) for n, f, _ in plan]


def _joined(first: int, filling: Filling) -> Filling:
    merged = dict(filling)
    merged[first] = merged.get(first, 0) + 1
    return tuple(sorted(merged.items(), reverse=True))


# --- pieces ---------------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then the end token."""
    path = tokenizer or tokenizing.default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokenizing.words(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                ids = words.ids(text or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    part = ids[4 * start : 4 * stop]
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(part), *[np.frombuffer(part, "<u4").astype(np.int32)] * with_ids))
                if len(out) >= 20_000 or with_ids and len(out) >= 1_000:
                    yield frame(out)
                    out = []
            yield frame(out)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with ``sequence_id`` and ``offset``; with ``with_ids`` also their token ids."""
    small_batches(docs.sparkSession)
    cut = materialize(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    lookup = _lookup(complete(counts, capacity))
    salts = [max(1, counts.get(length, 0) // SALT_ROWS) for length in range(capacity + 1)]
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(salts), F.col("length").cast("int"))))
    before = salted.groupBy("length", "salt").count().selectExpr("length", "salt", "sum(count) over (partition by length order by salt) - count as before")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, piece, ids_crc32) - 1 as at")
    placed = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(lookup.find(length.to_numpy(np.int64), rank.to_numpy(np.int64)), columns=["sequence_id", "offset"])

    return placed.withColumn("_to", place("length", "rank")).select(*cut.columns, "_to.sequence_id", "_to.offset")


class _lookup:
    """The plan by length: runs of ranks that share a filling. Its size depends on the capacity only."""

    def __init__(self, plan: Plan):
        runs, taken, sequence = [], {}, 0
        for n, filling in plan:
            offset = 0
            for length, copies in filling:
                runs.append((length, taken.get(length, 0), copies, sequence, offset))
                taken[length] = taken.get(length, 0) + n * copies
                offset += copies * length
            sequence += n
        self.runs = np.array(sorted(runs), np.int64).reshape(-1, 5)

    def find(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros((len(length), 2), np.int64)
        for value in np.unique(length):
            mine = self.runs[self.runs[:, 0] == value]
            rows = np.flatnonzero(length == value)
            run = mine[np.searchsorted(mine[:, 1], rank[rows], "right") - 1]
            bins, copy = np.divmod(rank[rows] - run[:, 1], run[:, 2])
            out[rows, 0], out[rows, 1] = run[:, 3] + bins, run[:, 4] + copy * value
        return out
