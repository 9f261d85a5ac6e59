"""Operator 8, exact n-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets form one class and are compared once. Tokens (shingle hashes) are ordered
from rare to frequent by a sketch of counts over the whole corpus. Two sets of n and m that link share o =
ceil(t (n + m) / (1 + t)) tokens at least, so they share k tokens among the first n - o + k of the one and
m - o + k of the other, for any k.

* A document with enough rare tokens picks the k with the least estimated cost (a longer prefix costs postings,
  a short one verifications); a pair is verified if it shares as many prefix tokens as the weaker of its two
  prefixes promises. Such prefixes hold rare tokens only, so posting lists are short.
* A document that is mostly frequent tokens (a near copy in a large group) posts all its rare ones, for k = 1. A
  partner that shares none of them has to agree almost fully on the frequent ones: both sets together miss
  D = n + m - 2 o - (rare tokens of either) at most. So the prefix is lengthened to all frequent tokens, dealt
  into parts by hash, and whole parts have to match, all but D of them. Parts are ordered from rare to frequent
  in turn, so a pair meets in one of the D + 1 rarest parts of either; where copies differ, parts are rare. How
  many parts, follows from a document's rare tokens; parts halve from level to level, and a pair meets at the
  finer of its two levels. If hashing leaves too few parts with tokens, the single tokens of the ordinary prefix are posted.

Candidates are checked by their sets' counts by hash range (256 of them), which bound the overlap from above,
and then by whole sets. Only links between different components are of use to the component ids, so the join
goes in two steps. First every list is linked as a star around its most central member, which joins large
groups of near copies at linear cost; then lists that still hold several components are searched for the pairs
between those.

Shingles are 64-bit hashes of their words and classes 128 bits over these; equal hashes count as equal words.

Cases: null and empty texts, and texts without words, have the empty set and link with nothing
(their component is their own row's doc_id); fewer words than a shingle are one shingle; repeated
rows and equal sets link with each other; ties in rank go by hash; texts of any length are read whole; a null
doc_id has a null component unless it links to a document with an id; an empty table gives an empty result.
Columns other than doc_id and text, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_table, materialize, mix64, parts, small_batches
from .words import encode, word_hashes

WORDS = 5
PERCENT = 80
SKETCH_BITS = 20
MOST_MATCHES = 16
CHANCE = 0.5  # partners that any token may bring unseen by the sketch
FREQUENT = 5  # doublings above an ordinary cell's count from which a token counts as frequent
TOKEN = -1  # the level of rare tokens
SPARE_PARTS = 16
SINGLE = 99  # the level of single frequent tokens
SIZE_STEP = 1.05
SLICE = 200  # texts of an Arrow batch that a worker takes at a time


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    h = word_hashes(encode(text), "solid")[0]
    if not len(h):
        return h
    if len(h) < words:
        words = len(h)
    out = np.zeros(len(h) - words + 1, np.uint64)
    for k in range(words):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - words + 1 + k])
    return np.unique(out)


def _signature(s: np.ndarray) -> bytes:
    """128 bits that name a non-empty shingle set."""
    a = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = (mix64(s) | np.uint64(1)).prod(dtype=np.uint64) ^ np.uint64(len(s))
    return np.array([a, b], np.uint64).tobytes()


def count_sketch(texts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Shingle counts over all ``texts`` in 2^bits cells: of fixed size, never below the true counts.

    A task sends its cells in blocks, which are summed block by block; the driver gets the sums.
    """
    block = 1 << 14

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(1 << bits, np.int64)
        for b in batches:
            for lo in range(0, len(b), SLICE):
                found = [shingles(t) >> np.uint64(64 - bits) for t in b["text"].iloc[lo : lo + SLICE] if t]
                if found:
                    cells, n = np.unique(np.concatenate(found).astype(np.int64), return_counts=True)
                    out[cells] += n
        yield _blocks(dict(enumerate(out.reshape(-1, block))))

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(b["block"], b["cells"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(cells, np.int64)
        yield _blocks(sums)

    schema = "block int, cells binary"
    sent = texts.select("text").mapInPandas(count, schema)
    out = np.zeros(1 << bits, np.int64)
    for row in sent.repartition(parts(texts.sparkSession), "block").mapInPandas(total, schema).toLocalIterator():
        out[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["cells"], np.int64)
    return out


def _blocks(cells: dict[int, np.ndarray]) -> pd.DataFrame:
    kept = {k: v for k, v in cells.items() if v.any()}
    return pd.DataFrame({"block": list(kept), "cells": [v.tobytes() for v in kept.values()]}).astype({"block": "int32"})


def frequency_ranks(cells: np.ndarray) -> np.ndarray:
    """One small number for each cell: the doublings of its count above what an ordinary cell holds."""
    usual = np.median(cells)
    return np.log2(np.maximum(cells - usual - 3 * np.sqrt(usual + 1), 1)).astype(np.uint8)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shared shingles that a set of n needs at least with any set that it links to."""
    return -(-n * percent // 100)


def choose_prefix(n: int, partners: np.ndarray, most: int, percent: int = PERCENT, verify_cost: float = 50.0) -> int:
    """The number of matches k, ``most`` at most, with the least estimated cost.

    A prefix for k matches has n - ceil(t n) + k tokens, of which a partner of the same size sees the first
    n - ceil(2 t n / (1 + t)) + k. Each token costs one posting, and those seen bring about as many partners as
    they are frequent (``partners``, summed along the order); k matches asked for leave a k-th of these to verify.
    """
    same = -(-2 * n * percent // (100 + percent))
    k = np.arange(1, most + 1)
    return int(np.argmin(n - least_overlap(n, percent) + k + verify_cost * partners[n - same + k - 1] / k**2)) + 1


def wanted_parts(missed: float) -> float:
    """Parts with tokens that a set wants if a pair can miss so many: more than these, so that some are rare."""
    return missed + 1 + min(missed + 1, SPARE_PARTS)


def finest(n: float, percent: int = PERCENT) -> int:
    """The finest level at which a set of n tokens is posted for its own sake."""
    return int(np.ceil(np.log2(1.25 * wanted_parts(2 * n * (100 - percent) / (100 + percent)))))


def equal_parts(tokens: np.ndarray, level: int) -> np.ndarray:
    """One hash for each of the 2^level parts that holds any of ``tokens``: of its tokens, its place and the level."""
    mixed = np.sort(mix64(tokens ^ np.uint64(0x5DEECE66D1CE4E5B)))
    cell = mixed >> np.uint64(64 - level) if level else np.zeros(len(mixed), np.uint64)
    starts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1]
    sums = np.add.reduceat(mix64(mixed), starts)
    return mix64(sums + mix64(cell[starts] * np.uint64(128) + np.uint64(level + 1)))


def postings(s: np.ndarray, ranks: np.ndarray, percent: int = PERCENT, most: int = MOST_MATCHES) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(k, rare tokens, own level, and for each posting: key, level, parts of that level) of a set; the prefix comes first, in order."""
    bits = len(ranks).bit_length() - 1
    rank = ranks[(s >> np.uint64(64 - bits)).astype(np.int64)]
    order = np.lexsort((s, rank))
    n, room, rare = len(s), len(s) - least_overlap(len(s), percent), int((rank < FREQUENT).sum())
    if rare > room:
        partners = np.cumsum(np.exp2(rank[order].astype(np.float64)) - 1 + CHANCE)
        k = choose_prefix(n, partners, min(most, n - room, rare - room), percent)
        own, keys, levels, counts = TOKEN, [s[order[: room + k]]], [TOKEN], [0]
    else:
        k, missed = 1, max(0, int(np.floor(2 * (n * (100 - percent) / (100 + percent) - rare))))
        frequent = s[order[rare:]]
        own, keys, levels, counts = SINGLE, [s[order[:rare]]], [TOKEN], [0]
        for level in range(finest(n * 100 / percent, percent) + 1):
            if own == SINGLE and (level > finest(n, percent) or 1 << level < wanted_parts(missed)):
                continue
            found = equal_parts(frequent, level)
            if own == SINGLE and len(found) >= wanted_parts(missed):
                own = level
            if own != SINGLE:
                keys.append(found)
                levels.append(level)
                counts.append(len(found))
        keys.append(mix64(s[order[rare : room + 1]] ^ np.uint64(0xD1B54A32D192ED03)))
        levels.append(SINGLE)
        counts.append(0)
    sizes = [len(x) for x in keys]
    return k, rare, own, np.concatenate(keys), np.repeat(levels, sizes).astype(np.int32), np.repeat(counts, sizes).astype(np.int32)


def spread(s: np.ndarray) -> bytes:
    """Shingles by the top byte of their hash, 255 meaning that many or more."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def possible(pairs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose overlap can reach the threshold: no set shares more in a hash range than it has there."""

    @F.pandas_udf("boolean")
    def enough(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, 256) for v in (sa, sb))
        both = np.minimum(x, y)
        bound = both.sum(axis=1, dtype=np.int64)
        need = (na + nb).to_numpy() * percent
        return pd.Series((bound * (100 + percent) >= need) | (both.max(axis=1, initial=0) == 255))

    sides = [members.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("spread").alias(f"s{s}")) for s in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(enough("na", "nb", "sa", "sb")).select("a", "b")


def prefixes(docs: DataFrame, ranks: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(doc_id, class, n, k, rare, own, posts, spread) of every document; class is null for the empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["class", "n", "k", "rare", "own", "keys", "levels", "counts", "spread"]
        none = (None, 0, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), None)
        for b in batches:
            for lo in range(0, len(b), SLICE):  # postings take several times the room of their texts
                part, out = b.iloc[lo : lo + SLICE], []
                for t in part["text"]:
                    s = shingles(t)
                    if len(s):
                        k, rare, own, keys, levels, counts = postings(s, ranks, percent)
                        out.append((_signature(s), len(s), k, rare, own, keys.view(np.int64), levels, counts, spread(s)))
                    else:
                        out.append(none)
                yield pd.concat([part["doc_id"].astype("Int64").reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInPandas(run, "doc_id long, class binary, n long, k int, rare int, own int, keys array<long>, levels array<int>, counts array<int>, spread binary")


def _fits(a: str, b: str, percent: int = PERCENT) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def rarest_parts(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``lists`` with each document's parts of a level only as far as a pair may have to look, placed from rare to frequent.

    ``many`` is the length of a list. Parts that no other document holds come first; they aren't in ``lists``.
    """
    by = Window.partitionBy("id", "level")
    slack = F.col("n") * (100 - percent) / (100 + percent) - F.col("rare")
    of_level = F.pow(F.lit(2.0), F.col("level"))
    most = (F.greatest((of_level - 2) / 2, of_level - 1 - SPARE_PARTS) + 1) / 2  # the slack of documents of this level
    parts_ = lists.where(F.col("level").between(0, SINGLE - 1)).withColumn("place", F.col("parts") - F.count("*").over(by) + F.row_number().over(by.orderBy("many", "key")))
    return lists.where(F.col("level").isin(TOKEN, SINGLE)).unionByName(parts_.where(F.col("place") <= F.floor(slack + most + 1e-9) + 1))


def _over(n: str, m: str, percent: int) -> str:
    """SQL of the overlap that sets of n and m need."""
    return f"cast(ceil({percent} * ({n} + {m}) / {100 + percent}D - 1e-9) as bigint)"


def meetings(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, need): one row for each posting list in which two sets of different components (c) meet that may link.

    ``postings`` has key, level, place, id, n, k, rare, own and c. Within a list the most frequent component is never
    paired with itself: every pair has a side outside it. A set with so many rare tokens that only smaller
    partners are left meets those alone, by size class.
    """
    held = postings.groupBy("key", "level", "c").agg(F.count("*").alias("x"), F.bool_or(F.expr(f"level = own or level = {TOKEN}")).alias("leads"))
    lists = held.groupBy("key", "level").agg(F.max_by("c", F.struct("x", "c")).alias("major"), F.count("*").alias("cs"), F.bool_or("leads").alias("leads"))
    open_ = materialize(lists.where("cs > 1 and leads").select("key", "level", "major"), "open")
    limit = f"({100 + percent} * (n - rare) / {percent}D - n + 1e-9)"  # the largest partner that a set can miss its rare tokens with
    sides = postings.join(open_, ["key", "level"]).selectExpr("*", "c <> major as minor", f"level <> {TOKEN} and n > {limit} as strict", f"{limit} as most")
    sides = materialize(sides.drop("major"), "sides")
    one, two = (sides.select("key", "level", *[F.col(c).alias(f"{c}{i}") for c in sides.columns if c not in ("key", "level")]) for i in "12")
    need = _over("n1", "n2", percent)
    fits = f"c1 <> c2 and {_fits('n1', 'n2', percent)}"
    rare = f"{fits} and id1 < id2 and place1 <= n1 - {need} + least(k1, k2) and place2 <= n2 - {need} + least(k1, k2)"
    missed = f"n1 + n2 - 2 * {need} - rare1 - rare2"
    near = f"(level = {SINGLE} or greatest(place1, place2) <= {missed} + 1)"
    parts_ = f"{fits} and n1 - rare1 >= {need} and n2 - rare2 >= {need} and {missed} >= 0 and {near}"

    def paired(a: DataFrame, b: DataFrame, on: list[str], real: str) -> DataFrame:
        """Pairs of a list but those within its main component."""
        return a.where("minor1").join(b, on).where(real).unionByName(a.where("not minor1").join(b.where("minor2"), on).where(real))

    ordered = "(own1 = level and (own2 < level or id1 < id2))"
    size_class = lambda x: F.floor(F.log(x) / np.log(SIZE_STEP) + 1e-9).cast("int")
    narrow = one.where("strict1").withColumn("g", F.explode(F.sequence(size_class(F.expr(f"ceil({percent} * n1 / 100D - 1e-9)")), size_class(F.greatest("most1", F.expr(f"{percent} * n1 / 100D"))))))
    wide = two.where("not strict2").withColumn("g", size_class(F.col("n2")))
    tokens = [x.where(F.col("level") == TOKEN) for x in (one, two)]
    frequent = [x.where(f"level <> {TOKEN} and not strict{i}") for x, i in ((one, 1), (two, 2))]
    found = paired(*tokens, ["key", "level"], rare).selectExpr("id1", "id2", "least(k1, k2) as need")
    for x in (
        paired(*frequent, ["key", "level"], f"{parts_} and {ordered}"),
        paired(narrow, wide, ["key", "level", "g"], f"{parts_} and greatest(own1, own2) = level"),
    ):
        found = found.unionByName(x.selectExpr("id1", "id2", "1 as need"))
    return found.selectExpr("least(id1, id2) as a", "greatest(id1, id2) as b", "need")


def across(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of different components that meet as often as sets that link must, by rare tokens or by parts."""
    return meetings(postings, percent).groupBy("a", "b", "need").count().where("count >= need").select("a", "b").distinct()


def whole_sets(wanted: DataFrame, docs: DataFrame, bits: int = 22) -> DataFrame:
    """(id, tokens): the shingle sets of the ``wanted`` classes (id, class, rep).

    A task makes sets only of documents whose ids may be wanted, in one Python worker. Where an id is given more than
    once, its set is the one of the class itself.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int")
    seen = np.zeros(1 << bits, bool)
    seen[wanted.select(at("rep").alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)] = True
    seen = np.packbits(seen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = b["at"].to_numpy()
            b = b[(seen[k >> 3] >> (7 - (k & 7)) & 1).astype(bool)]
            for lo in range(0, len(b), SLICE):
                part = b.iloc[lo : lo + SLICE]
                sets = [shingles(t) for t in part["text"]]
                some = np.array([len(s) > 0 for s in sets])
                sets = [s for s in sets if len(s)]
                yield pd.DataFrame({"rep": part["rep"][some].astype("Int64").to_numpy(), "class": [_signature(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]})

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("rep"), "text").select("rep", "text", at("rep").alias("at"))
    made = texts.mapInPandas(run, "rep long, class binary, tokens array<long>").dropDuplicates(["rep", "class"])
    m, w = made.alias("m"), wanted.alias("w")
    return m.join(w, F.expr("m.class = w.class and m.rep <=> w.rep")).select("w.id", "m.tokens")


def verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b: ids of ``members``) whose whole sets reach the threshold."""
    pairs = materialize(possible(pairs, members, percent), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(members.select("id", "class", "rep").join(ids, "id"), "wanted")
    sets = materialize(whole_sets(wanted, docs), "sets")
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("right")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("left")), "a")
    shared = F.size(F.array_intersect("left", "right"))
    links = materialize(both.where((100 + percent) * shared >= percent * (F.size("left") + F.size("right"))).select("a", "b"), "links")
    for x in (pairs, wanted, sets):
        drop_table(x)
    return links


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; see the module for the method."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    ranks = frequency_ranks(count_sketch(docs))
    signed = materialize(prefixes(docs, ranks, percent), "prefixes")
    carried = ("n", "k", "rare", "own", "keys", "levels", "counts", "spread")
    classes = signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in carried])
    members = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    zipped = F.posexplode(F.arrays_zip("keys", "levels", "counts")).alias("place", "post")
    posted = members.select(zipped, "id", "n", "k", "rare", "own").selectExpr("post.keys as key", "post.levels as level", "place + 1 as place", "post.counts as parts", "id", "n * 32 + k as nk", "rare * 128 + own + 1 as ro")
    many = posted.groupBy("key", "level").agg(F.count("*").alias("many")).where("many > 1")
    many = materialize(many, "lists")  # stored, so that the join below may split a long list
    shared = posted.join(many, ["key", "level"]).selectExpr("key", "level", "place", "parts", "id", "nk div 32 as n", "cast(nk % 32 as int) as k", "ro div 128 as rare", "cast(ro % 128 - 1 as int) as own", "many")
    lists = materialize(rarest_parts(shared, percent), "postings")

    central = F.struct(F.col("rare") / F.col("n"), F.col("id"))
    pivots = materialize(lists.groupBy("key", "level").agg(F.min_by(F.struct("id", "n", "k"), central).alias("pivot")), "pivots")
    met = lists.join(pivots, ["key", "level"]).where("id <> pivot.id").where(_fits("n", "pivot.n", percent))
    stars = met.groupBy("id", F.col("pivot.id").alias("pivot"), F.expr("least(k, pivot.k)").alias("k"), (F.col("level") == TOKEN).alias("token")).count()
    close = stars.where("not token").groupBy("id").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    stars = stars.where("token and count >= k").select("id", "pivot").union(close.select("id", "pivot")).distinct()
    first = verified(stars.select(F.col("pivot").alias("a"), F.col("id").alias("b")), members, docs, percent)
    joined = components(first, "first")

    at = lists.drop("many", "parts").join(joined.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")
    rest = verified(across(at, percent), members, docs, percent)
    whole = components(first.union(rest), "whole")

    rooted = members.select("class", "id", "rep").join(whole.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    out = signed.select("doc_id", "class", F.col("n").alias("n_shingles")).join(named, "class", "left")
    for x in (many, lists, pivots):
        drop_table(x)
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
