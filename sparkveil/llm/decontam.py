"""Operator 7, benchmark decontamination over a distributed positional inverted index.

1. Corpus frequencies of all benchmark terms are counted over all documents.
2. Each window of ten consecutive item words picks its ``RAREST`` rarest terms.
3. The index stores the postings (term, document, position) of the picked terms.
4. Offset-adjusted postings meet per document, item and alignment (document position minus item
   position); an alignment survives if as many picked terms are there as a window has.
5. Surviving alignments are read against the document's words, byte for byte, which gives the
   exact hits. ``proximity`` answers the looser question: picked terms of a window within a span.

Python tasks pre-filter words with a bitmap of fixed size, whatever the benchmark holds; the exact
test is a join, so false positives of the bitmap cost time only.

Cases: null and empty texts have no words and no hits; items without words are ignored, items of
fewer than ten words are one window; a null item_id counts as the empty string; repeated items
with one id count once; repeated documents are judged one by one; empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .words import encode, word_hashes

WINDOW = 10
RAREST = 2
FILTER_BITS = 22


def _row_key():
    """Names a document row: equal rows share it, copies under other ids don't. Should two rows ever share it
    by chance, both are read for the alignments of either, and the words decide."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x02")), "text")


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text, words): one row for each distinct item with words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null").distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(words=[word_hashes(encode(t), "alnum")[0].view(np.int64) for t in b["text"]])

    hashed = items.mapInPandas(split, "item_id string, text string, words array<long>").where("size(words) > 0")
    return materialize(hashed.withColumn("item", F.xxhash64("item_id", "text")), "items")


def term_filter(terms: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of 2^bits places with those of the terms set; its size doesn't depend on their number."""
    places = terms.select(F.shiftrightunsigned("term", 64 - bits).alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)
    out = np.zeros(1 << bits, bool)
    out[places] = True
    return np.packbits(out)


def _kept(h: np.ndarray, packed: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    at = (h >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)


def corpus_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) of all ``terms`` over all documents; n is 0 for terms that don't occur."""
    packed = term_filter(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [word_hashes(encode(t), "alnum")[0] for t in b["text"] if t]
            found = np.concatenate([h[_kept(h, packed)] for h in hashes]) if hashes else np.zeros(0, np.uint64)
            term, n = np.unique(found.view(np.int64), return_counts=True)
            yield pd.DataFrame({"term": term, "n": n})

    counted = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def pick_rarest(items: DataFrame, frequencies: DataFrame, rarest: int = RAREST, window: int = WINDOW) -> DataFrame:
    """(item, windows): for each window of an item the item positions of its rarest terms."""
    placed = items.select("item", F.posexplode("words").alias("at", "term")).join(frequencies, "term")
    rows = placed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("f"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f in b["f"]:
                n = np.array([x["n"] for x in f], np.int64)
                size = min(window, len(n))
                views = np.lib.stride_tricks.sliding_window_view(n, size)
                order = np.argsort(views, axis=1, kind="stable")[:, : min(rarest, size)]
                out.append(np.unique(np.sort(order + np.arange(len(views))[:, None], axis=1), axis=0).tolist())
            yield pd.DataFrame({"item": b["item"], "windows": out})

    return materialize(rows.mapInPandas(choose, "item long, windows array<array<int>>"), "windows")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored positional index of ``terms``: (term, doc, p), one row for each posting."""
    packed = term_filter(terms)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [word_hashes(encode(t), "alnum")[0] for t in b["text"]]
            kept = [_kept(h, packed) for h in hashes]
            yield pd.DataFrame({"doc": b["doc"], "term": [h[k].view(np.int64) for h, k in zip(hashes, kept, strict=True)], "p": [k.astype(np.int32) for k in kept]})

    raw = docs.select(_row_key().alias("doc"), "text").mapInPandas(post, "doc long, term array<long>, p array<int>").where("size(term) > 0")
    return materialize(raw.select("doc", F.explode(F.arrays_zip("term", "p")).alias("x")).select("x.term", "doc", "x.p"), "index")


def aligned(index: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, item, shift): alignments with as many picked terms as a window of the item has.

    Position and item word fix the alignment, so a document gives each picked term of an alignment once
    and counting rows counts terms.
    """
    picked = windows.select("item", F.array_min(F.transform("windows", F.size)).alias("need"), F.explode(F.array_distinct(F.flatten("windows"))).alias("at"))
    anchors = items.join(picked, "item").select("item", "need", "at", F.element_at("words", F.col("at") + 1).alias("term"))
    lists = index.join(anchors, "term").select("doc", "item", (F.col("p") - F.col("at")).alias("shift"), "need")
    met = lists.groupBy("doc", "item", "shift").agg(F.count("*").alias("found"), F.max("need").alias("need"))
    return met.where("found >= need").select("doc", "item", "shift")


def proximity(index: DataFrame, items: DataFrame, windows: DataFrame, span: int = 2 * WINDOW) -> DataFrame:
    """(doc, item): documents that hold all picked terms of some window of the item within ``span`` words."""
    one = windows.select("item", F.posexplode("windows").alias("w", "ats"))
    wanted = one.join(items.select("item", "words"), "item").select(
        "item", "w", F.explode(F.transform("ats", lambda a: F.get("words", a))).alias("term"), F.size(F.array_distinct(F.transform("ats", lambda a: F.get("words", a)))).alias("terms")
    ).distinct()
    near = index.join(wanted, "term").select("doc", "item", "w", "terms", "term", "p")
    blocks = near.withColumn("block", F.explode(F.array((F.col("p") / span).cast("int"), (F.col("p") / span).cast("int") - 1)))
    around = blocks.groupBy("doc", "item", "w", "terms", "block").agg(F.sort_array(F.collect_list(F.struct("p", "term"))).alias("ps"))
    within = F.exists("ps", lambda s: F.size(F.array_distinct(F.transform(F.filter("ps", lambda x: (x["p"] >= s["p"]) & (x["p"] < s["p"] + span)), lambda x: x["term"]))) == F.col("terms"))
    return around.where(within).select("doc", "item").distinct()


def _spans(text: str | None, found: list, window: int) -> tuple[int, np.ndarray, list[str]]:
    """(number of words, hit flags, ids of the items with an occurring window), by comparing words themselves."""
    raw = encode(text)
    h, starts, ends = word_hashes(raw, "alnum")
    hit, ids = np.zeros(len(h), bool), set()
    body = raw.tobytes()
    for c in found:
        item = encode(c["text"])
        ih, istarts, iends = word_hashes(item, "alnum")
        size, shift = min(window, len(ih)), c["shift"]
        lo, hi = max(0, -shift), min(len(ih), len(h) - shift)
        if hi - lo < size:
            continue
        same = h[lo + shift : hi + shift] == ih[lo:hi]
        edges = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
        for a, b in zip(edges[::2] + lo, edges[1::2] + lo, strict=True):
            if b - a < size:
                continue
            ours = [body[x:y] for x, y in zip(starts[a + shift : b + shift], ends[a + shift : b + shift], strict=True)]
            theirs = [item[x:y].tobytes() for x, y in zip(istarts[a:b], iends[a:b], strict=True)]
            if ours == theirs:
                hit[a + shift : b + shift] = True
                ids.add(c["item_id"])
    return len(h), hit, sorted(ids)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted) and hit_spans (word ranges [from, to))."""
    small_batches(docs.sparkSession)
    keys = docs.withColumn("_doc", _row_key())
    items = item_words(benchmark)
    frequencies = materialize(corpus_frequencies(docs, items.select(F.explode("words").alias("term")).distinct()), "frequencies")
    windows = pick_rarest(items, frequencies, window=window)
    picked = windows.select("item", F.explode(F.array_distinct(F.flatten("windows"))).alias("at"))
    terms = items.join(picked, "item").select(F.element_at("words", F.col("at") + 1).alias("term")).distinct()
    index = build_index(docs, terms)
    hits = aligned(index, items, windows).join(items.select("item", "item_id", "text"), "item")
    per_doc = hits.groupBy("doc").agg(F.collect_list(F.struct("item_id", "text", "shift")).alias("_found")).withColumnRenamed("doc", "_doc")

    @F.pandas_udf("n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<lo: int, hi: int>>")
    def verify(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for text, f in zip(texts, found, strict=True):
            n, hit, ids = _spans(text, [] if f is None else list(f), window)
            edges = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
            out.append((n, int(hit.sum()), ids, [{"lo": int(a), "hi": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "item_ids", "hit_spans"])

    names = ("n_words", "n_hit", "item_ids", "hit_spans")
    joined = keys.join(per_doc.hint("shuffle_hash"), "_doc", "left")
    return joined.withColumn("_v", verify("text", "_found")).select(*[c for c in docs.columns if c not in names], *[f"_v.{c}" for c in names])

