"""Operator 9, exact removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. Several lengths can
be asked for at once; the least of them decides how the corpus is dealt out.

1. Anchors deal out the corpus. Every window of the least length holds one anchor: its least (by hash)
   string of ``GRAM`` bytes, the leftmost of equal ones. Equal windows have equal anchors at equal places,
   so windows need to be compared only where their anchors agree. An anchor stands for a run of windows;
   the text of the run is its segment. A segment that its document holds twice is settled there, and a
   segment that several documents hold is settled by its digest: all its windows repeat.
2. The suffix sort finds the rest. The distinct segments of an anchor are sorted twice by mergesort, as
   suffixes from the anchor on and as reversed prefixes up to it; prefix polynomial hashes and binary
   search give the common extension of two suffixes, so a comparison takes logarithmic time. Extensions of
   neighbours are verified byte by byte before they are used. A window that starts d bytes before the
   anchor repeats if another segment agrees with its own for d bytes to the left and length - d to the right,
   that is if both lie in one stretch of either order.
3. An anchor with more than ``GROUP_ROWS`` distinct segments is dealt out anew: its windows are split by
   their distance from the anchor, and each part by the bytes that all its windows contain, until no part
   is too large or its windows agree. So no group has to fit a task, and nothing is decided otherwise.

Digests are 128 bits of BLAKE2b over the bytes; they stand for the bytes between documents.

Cases: null and empty texts, and texts shorter than the length, lose nothing; texts are judged as UTF-8
bytes; repeated rows remove each other whole if they are long enough; rows that tie in id and text get the
same result; an empty table gives an empty result; texts of any length are worked on in blocks. Extra
columns go through, whatever their names, but for those that the result defines itself, which are replaced.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, materialize, mix64, parts, prefix_hash, slice_hash, small_batches, symbol_table

LENGTH = 400
PASSAGE = 250  # 50 words of five bytes, blanks counted: no passage of more words is shorter
GRAM = 32
GROUP_ROWS = 3_000
SPLIT = 8
BLOCK = 1 << 19  # window starts looked at together; positions in a block fit POSITION_BITS
POSITION_BITS = 20
_SYMBOLS = symbol_table(909)


def to_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor position, first and last window start) of all runs of windows of ``length`` bytes."""
    out = [_block_anchors(raw[lo : lo + BLOCK + length - 1], lo, length, gram) for lo in range(0, len(raw) - length + 1, BLOCK)]
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block_anchors(raw: np.ndarray, base: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    h = prefix_hash(_SYMBOLS[raw])
    at = np.arange(len(raw) - gram + 1)
    grams = mix64(slice_hash(h, at, at + gram))
    low = np.uint64((1 << POSITION_BITS) - 1)
    keys = (grams & ~low) | at.astype(np.uint64)
    width = length - gram + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - length + 1
    chosen = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    cut = np.flatnonzero(np.diff(chosen)) + 1
    first, last = np.r_[0, cut], np.r_[cut, n] - 1
    p = chosen[first]
    return grams[p], p + base, first + base, last + base


# --- the suffix sort --------------------------------------------------------------------------------


class Suffixes:
    """Byte strings one after the other, with prefix hashes for comparisons in logarithmic time."""

    def __init__(self, strings: list[bytes]):
        self.raw = np.frombuffer(b"".join(strings), np.uint8)
        self.hash = prefix_hash(_SYMBOLS[self.raw])
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings of strings x and y, by binary search on hashes."""
        a, b = self.start[x], self.start[y]
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_] + 1) // 2
            i, j = a[open_], b[open_]
            same = slice_hash(self.hash, i, i + mid) == slice_hash(self.hash, j, j + mid)
            lo[open_], hi[open_] = np.where(same, mid, lo[open_]), np.where(same, hi[open_], mid - 1)
        return lo

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of strings; a beginning of a string comes before it."""
        k = self.extension(x, y)
        inside = (k < self.size[x]) & (k < self.size[y])
        out = np.sign(self.size[x] - self.size[y])
        i, j = x[inside], y[inside]
        out[inside] = np.where(self.raw[self.start[i] + k[inside]] < self.raw[self.start[j] + k[inside]], -1, 1)
        return out

    def order(self, group: np.ndarray) -> np.ndarray:
        """The strings, given group by group, sorted within each group.

        Bottom-up mergesort of all groups at once: each string finds its rank in the sibling run by binary search.
        """
        at = np.arange(len(group))
        starts = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
        sizes = np.diff(np.r_[starts, len(at)])
        width = 1
        while (busy := sizes > width).any():
            idx = np.flatnonzero(np.repeat(busy, sizes))
            base, size = np.repeat(starts[busy], sizes[busy]), np.repeat(sizes[busy], sizes[busy])
            i = idx - base
            run = i // width
            lo = np.minimum((run ^ 1) * width, size)
            first, hi = lo.copy(), np.minimum(lo + width, size)
            left = (run & 1) == 0
            while len(live := np.flatnonzero(lo < hi)):
                mid = (lo[live] + hi[live]) // 2
                c = self.compare(at[base[live] + mid], at[idx[live]])
                ahead = (c < 0) | ((c == 0) & ~left[live])
                lo[live], hi[live] = np.where(ahead, mid + 1, lo[live]), np.where(ahead, hi[live], mid)
            target = base + (run & ~1) * width + (i - run * width) + (lo - first)
            moved = at[idx]
            at[target] = moved
            width *= 2
        return at

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For each place of ``order`` the common extension with the place before, -1 for the first of a group; verified by bytes."""
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        x, y = order[at - 1], order[at]
        k = self.extension(x, y)
        ends = np.cumsum(k)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - k, k)
        equal = self.raw[np.repeat(self.start[x], k) + inner] == self.raw[np.repeat(self.start[y], k) + inner]
        if not equal.all():
            raise HashCollision
        out[at] = k
        return out


class HashCollision(Exception):
    """Two different strings have one polynomial hash."""


def sorted_with_extensions(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, verified extensions of neighbours); strings whose hashes collide are ordered by their bytes alone."""
    s = Suffixes(strings)
    try:
        order = s.order(group)
        return order, s.neighbours(order, group)
    except HashCollision:
        order = np.array(sorted(range(len(strings)), key=lambda i: (group[i], strings[i])), np.int64)
        out = np.full(len(order), -1, np.int64)
        for i in range(1, len(order)):
            if group[order[i]] == group[order[i - 1]]:
                a, b = (np.frombuffer(strings[order[j]], np.uint8) for j in (i - 1, i))
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                out[i] = differ[0] if len(differ) else m
        return order, out


def repeated_windows(segments: list[bytes], group: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, least distance, greatest distance) of the runs of windows that another segment of the group holds too.

    ``left`` is the place of the anchor in its segment; ``lo`` to ``hi`` are the distances of a segment's windows
    from it. Equal groups stand together.
    """
    right, r = sorted_with_extensions([s[k:] for s, k in zip(segments, left, strict=True)], group)
    back, l_ = sorted_with_extensions([s[:k][::-1] for s, k in zip(segments, left, strict=True)], group)
    size = np.array([len(s) for s in segments], np.int64) - left
    hi = np.minimum(hi, left)
    lo = np.maximum(lo, length - size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stretch = np.empty(len(segments), np.int64)
    other = np.empty(len(segments), np.int64)
    first, last = (int(lo.min()), int(hi.max())) if len(segments) else (0, -1)
    for d in range(first, last + 1):
        own = np.flatnonzero((lo <= d) & (d <= hi))
        if len(own) < 2:
            continue
        stretch[right] = np.cumsum(r < length - d)
        other[back] = np.cumsum(l_ < d)
        key = stretch[own] * (len(segments) + 1) + other[own]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        many = np.zeros(len(own), bool)
        many[by[1:][same]] = many[by[:-1][same]] = True
        if many.any():
            x = own[many]
            found.append((x, np.full(len(x), d, np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    x, d = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((d, x))
    x, d = x[by], d[by]
    new = np.r_[True, (x[1:] != x[:-1]) | (d[1:] != d[:-1] + 1)]
    ends = np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]
    return x[new], d[new], d[ends]


def without_spans(text: str, spans: list) -> str:
    """``text`` without the byte ranges ``spans``; a character of which they take a part goes whole."""
    raw, out, done = to_bytes(text).tobytes(), [], 0
    for s in spans:
        lo, hi = s["lo"], s["hi"]
        while lo > done and raw[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi += 1
        out.append(raw[done:lo])
        done = max(hi, done)
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


# --- the distributed operator ---------------------------------------------------------------------


def _row_key():
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x02")), F.md5(F.coalesce("text", F.lit(""))))))


def _digest(raw: bytes, *numbers: int) -> bytes:
    return blake2b(raw, digest_size=16, person=struct.pack("<qq", *numbers)).digest()


def find_anchors(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Segments of every text: h (anchor), s (digest), n (1, or 2 for more in this text), row, p, lo, hi, e (end of the segment).

    Runs of windows of segments that a text holds twice come besides with n = 0, joined where they touch.
    """
    base, most = min(lengths), max(lengths)

    def of(row: bytes, raw: np.ndarray) -> Iterator[tuple]:
        h, p, lo, hi = anchors(raw, base)
        e = np.minimum(hi + most, len(raw))
        whole = raw.tobytes()
        s = [_digest(whole[a:z], q - a, b - a) for q, a, b, z in zip(p.tolist(), lo.tolist(), hi.tolist(), e.tolist(), strict=True)]
        if len(seen := dict(zip(reversed(s), reversed(range(len(s))), strict=True))) == len(s):
            yield h, s, np.ones(len(s), np.int32), [row] * len(s), p, lo, hi, e
            return
        many = Counter(s)
        first = np.sort(np.fromiter(seen.values(), np.int64, len(seen)))
        kinds = [s[i] for i in first]
        yield h[first], kinds, np.array([min(many[x], 2) for x in kinds], np.int32), [row] * len(first), p[first], lo[first], hi[first], e[first]
        own = np.array([many[x] > 1 for x in s])
        start, end = np.flatnonzero(own & np.r_[True, ~own[:-1]]), np.flatnonzero(own & np.r_[~own[1:], True])
        yield h[start], [None] * len(start), np.zeros(len(start), np.int32), [row] * len(start), p[start], lo[start], hi[end], e[end]

    def frame(found: list[tuple]) -> pd.DataFrame:
        h, s, n, row, *places = zip(*found, strict=True)
        out = {"h": np.concatenate(h).view(np.int64), "s": list(chain.from_iterable(s)), "n": np.concatenate(n), "row": list(chain.from_iterable(row))}
        return pd.DataFrame(out | {k: np.concatenate(v) for k, v in zip(("p", "lo", "hi", "e"), places, strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b["row"], b["text"], strict=True):
                raw = to_bytes(text)
                if len(raw) >= base:
                    out += of(key, raw)
                if len(out) >= 500:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    return docs.select("row", "text").mapInPandas(run, "h long, s binary, n int, row binary, p long, lo long, hi long, e long")


def _sorted_runs(batches: Iterator[pd.DataFrame], at_once: int = GROUP_ROWS) -> Iterator[pd.DataFrame]:
    """Repeated runs of the segments that arrive ordered by length and group."""
    held: list[pd.DataFrame] = []
    rows = 0

    def work(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for length, part in df.groupby("length", sort=False):
            group = np.cumsum(np.r_[0, (part["g"].to_numpy()[1:] != part["g"].to_numpy()[:-1]).astype(np.int64)])
            x, least, most = repeated_windows(part["segment"].tolist(), group, part["left"].to_numpy(np.int64), part["d_lo"].to_numpy(np.int64), part["d_hi"].to_numpy(np.int64), int(length))
            mine = part["n"].to_numpy()[x] == 1  # the windows of the others are settled
            p = part["p"].to_numpy()[x]
            yield pd.DataFrame({"row": part["row"].to_numpy()[x], "lo": p - most, "hi": p - least, "length": length})[mine]

    for b in batches:
        held.append(b)
        rows += len(b)
        if rows < at_once:
            continue
        df = pd.concat(held, ignore_index=True)
        same = (df["g"] == df["g"].iloc[-1]) & (df["length"] == df["length"].iloc[-1])  # the last group may go on
        whole = int((~same).sum())
        if whole:
            yield from work(df.iloc[:whole])
        held, rows = [df.iloc[whole:]], len(df) - whole
    if rows:
        yield from work(pd.concat(held, ignore_index=True))


_PIECES = "length int, g binary, s binary, n long, row binary, p long, left long, d_lo long, d_hi long, segment binary"


def _finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece as up to SPLIT pieces of fewer windows, grouped by the bytes that all windows of such a piece contain."""
    for b in batches:
        out = []
        for x in b.itertuples(index=False):
            step = max(1, -(-x.span // SPLIT))
            for c in range(x.d_lo // step, x.d_hi // step + 1):
                near, far = c * step, (c + 1) * step - 1  # the cell's distances; its core lies in all its windows
                lo, hi = max(x.d_lo, near), min(x.d_hi, far)
                a, z = x.left - hi, x.left - lo + x.length
                core = x.segment[x.left - near : x.left - far + x.length]
                cut = x.segment[a:z]
                out.append((x.length, _digest(x.g + core, c, step), _digest(cut, hi, lo), x.n, x.row, x.p, hi, lo, hi, cut))
        yield pd.DataFrame(out, columns=["length", "g", "s", "n", "row", "p", "left", "d_lo", "d_hi", "segment"])


def settle(pieces: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(row, lo, hi, length) of the repeated runs of ``pieces``, groups of distinct segments; see part 3 of the module."""
    spark = pieces.sparkSession
    done, span = [], None
    while True:
        large = materialize(pieces.groupBy("length", "g").agg(F.count("*").alias("many"), F.min("d_lo").alias("a"), F.max("d_hi").alias("b")).where(F.col("many") > group_rows), "large")
        hot = large.agg(F.max(F.col("b") - F.col("a") + 1)).first()[0]
        few = pieces if hot is None else pieces.join(large.select("length", "g"), ["length", "g"], "left_anti")
        few = few.repartition(parts(spark), "length", "g").sortWithinPartitions("length", "g")
        done.append(few.mapInPandas(_sorted_runs, "row binary, lo long, hi long, length int"))
        if hot is None:
            break
        span = hot if span is None else max(1, -(-span // SPLIT))  # every cell of the last round had this many distances at most
        again = pieces.join(large.select("length", "g"), ["length", "g"]).withColumn("span", F.lit(span))
        cells = materialize(again.mapInPandas(_finer, _PIECES), "cells")
        one = F.min(F.struct("row", "p", "left", "d_lo", "d_hi", "segment"))
        kinds = materialize(cells.groupBy("length", "g", "s").agg(F.sum("n").alias("n"), one.alias("e")).select("length", "g", "s", "n", "e.*"), "kinds")
        equal = kinds.where("n > 1").select("length", "g", "s")
        done.append(cells.where("n = 1").join(equal, ["length", "g", "s"]).select("row", (F.col("p") - F.col("d_hi")).alias("lo"), (F.col("p") - F.col("d_lo")).alias("hi"), "length"))
        mixed = kinds.groupBy("length", "g").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("length", "g")
        pieces = materialize(kinds.join(mixed, ["length", "g"]), "finer")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def repeated_ranges(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), group_rows: int = GROUP_ROWS) -> DataFrame:
    """(row, lo, hi, length): runs of window starts that repeat; ``docs`` has row and text."""
    found = materialize(find_anchors(docs, lengths), "anchors")
    shared = materialize(found.where("n > 0").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeated")  # stored, so that the join below may split a hot anchor
    again = materialize(found.where("n > 0").join(shared, "h"), "shared")
    segments = materialize(again.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min(F.struct("row", "p", "lo", "hi", "e")).alias("x")), "segments")
    whole = again.where("n = 1").join(segments.where("n > 1").select("h", "s"), ["h", "s"]).unionByName(found.where("n = 0"), allowMissingColumns=True)
    whole = whole.select("row", "lo", "hi", "e", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("length"))
    whole = whole.select("row", "lo", F.least("hi", F.col("e") - F.col("length")).alias("hi"), "length").where("lo <= hi")

    mixed = segments.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("h")
    left = materialize(segments.join(mixed, "h").select("h", "s", "n", "x.*"), "left")
    bits = 22
    places = left.select(F.pmod(F.xxhash64("row"), F.lit(1 << bits)).cast("int").alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)
    seen = np.zeros(1 << bits, bool)
    seen[places] = True

    @F.pandas_udf("boolean")
    def maybe(at: pd.Series) -> pd.Series:
        return pd.Series(seen[at.to_numpy(np.int64)])

    texts = docs.select("row", "text").where(maybe(F.pmod(F.xxhash64("row"), F.lit(1 << bits))))
    wanted = left.groupBy("row").agg(F.collect_list(F.struct("h", "s", "n", "p", "lo", "hi", "e")).alias("cuts"))
    texts = texts.join(wanted, "row").dropDuplicates(["row"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["length", "g", "s", "n", "row", "p", "left", "d_lo", "d_hi", "segment"]
        for b in batches:
            out = []
            for row, text, cuts in zip(b["row"], b["text"], b["cuts"], strict=True):
                raw = to_bytes(text).tobytes()
                for c in cuts:
                    for length in lengths:
                        if c["lo"] + length <= c["e"]:
                            end = min(c["e"], c["hi"] + length)
                            out.append((length, struct.pack("<q", c["h"]), c["s"], c["n"], row, c["p"], c["p"] - c["lo"], c["p"] - (end - length), c["p"] - c["lo"], raw[c["lo"] : end]))
                if len(out) >= 5_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    pieces = materialize(texts.mapInPandas(cut, _PIECES), "pieces")
    out = materialize(settle(pieces, group_rows).unionByName(whole), "runs")
    for x in (found, shared, again, segments, left, pieces):
        drop_table(x)
    return out


def remove(docs: DataFrame, length: int = LENGTH, passage: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with kept_text (bytes), n_bytes, n_removed, removed_spans (byte ranges [lo, hi)) and passage_bytes.

    ``passage`` is a second length: passage_bytes counts the bytes that repeated strings of that length cover, which stay.
    """
    small_batches(docs.sparkSession)
    key, runs_ = fresh(docs, "row_key"), fresh(docs, "runs")
    keyed = docs.withColumn(key, _row_key())
    lengths = (length,) if passage in (None, length) else (length, passage)
    ranges = repeated_ranges(keyed.select(F.col(key).alias("row"), "text"), lengths, group_rows)
    spans = ranges.groupBy(F.col("row").alias(key)).agg(F.collect_list(F.struct("lo", "hi", "length")).alias(runs_))

    def covered(size: int, found: list, wanted: int) -> np.ndarray:
        depth = np.zeros(size + 1, np.int64)
        lo, hi = (np.array([r[k] for r in found if r["length"] == wanted], np.int64) for k in ("lo", "hi"))
        np.add.at(depth, lo, 1)
        np.add.at(depth, hi + wanted, -1)
        return np.cumsum(depth[:-1]) > 0

    @F.pandas_udf("kept_text binary, n_bytes long, n_removed long, removed_spans array<struct<lo: long, hi: long>>, passage_bytes long")
    def take(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, runs, strict=True):
            raw = to_bytes(text)
            if found is None or not len(found):
                out.append((raw.tobytes(), len(raw), 0, [], 0))
                continue
            gone = covered(len(raw), found, length)
            edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0])).tolist()
            spans = [{"lo": a, "hi": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            out.append((raw[~gone].tobytes(), len(raw), int(gone.sum()), spans, int(covered(len(raw), found, lengths[-1]).sum())))
        return pd.DataFrame(out, columns=["kept_text", "n_bytes", "n_removed", "removed_spans", "passage_bytes"])

    names, taken = ("kept_text", "n_bytes", "n_removed", "removed_spans", "passage_bytes"), fresh(docs, "taken")
    joined = keyed.join(spans.hint("shuffle_hash"), key, "left").withColumn(taken, take("text", runs_))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col(f"`{taken}`.{c}").alias(c) for c in names])
