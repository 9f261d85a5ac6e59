"""Operator 12, spelling variant grouping by permuterm rotations.

Every word ``w`` is marked with a terminator and rotated. A rotation that starts just behind character
``x`` of ``w = a x b`` reads ``b $ a x``; its prefix ``b $ a`` skips the edited character. In the sorted
rotations that prefix is a range, and in it stand exactly

* the words ``a y b`` for every ``y``, each one replacement away from the others, and
* the word ``a b``, whose whole rotation is the prefix, one deletion away from each of them.

A range has at most one word for each letter and the shorter word, so it is small whatever the input.
Ranges are scanned by a window; a word's neighbours in a range are counted and its best one is found
without writing pairs. A word that could lose any character of a run of equal ones meets its shorter
neighbour in several ranges; only the first of the run counts.

Rotations of words of over ``LONG`` code points are told apart by a digest of 128 bits, made for all
rotations in one pass, so that a run of any length takes space in proportion to its length.

Cases: null and empty texts have no words; repeated rows count each time; ties between forms go to the
smallest word in code-point order; words without near words have no form and are their own root; a null
id is written as nothing before the colon; runs of any length are handled; extra columns aren't read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, mix64, prefix_hash, slice_hash
from .merkle import ranked

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
LEAST_LENGTH, LEAST_COUNT = 5, 3
TYPO_EVERY = 97
TERMINATOR = "$"
LONG = 64
BATCH_WORDS = 200_000


def with_slips(doc_id: str, run: str) -> str:
    """The lower-cased run, of every 97th (id, run) without one of its characters."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % TYPO_EVERY == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def counts(docs: DataFrame, slip=with_slips, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts; ``slip`` changes a document's lower-cased run."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                for run, n in Counter(RUNS.findall(text or "")).items():
                    if len(run) >= least_length:
                        word = slip(doc_id, run.translate(_LOWER))
                        if len(word) >= least_length:
                            seen[word] += n
                if len(seen) >= BATCH_WORDS:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInPandas(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _digests(symbols: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of ``b $ a`` for every split of the word with one character skipped, then for every split with none."""
    points = mix64(symbols.astype(np.uint64) + np.uint64(seed))
    n = len(points)
    # the word, the terminator and the word again: every rotation is a slice of it
    twice = np.concatenate([points, mix64(np.array([seed ^ 0x24], np.uint64)), points])
    h = prefix_hash(twice)
    skipped, whole = np.arange(n), np.arange(n + 1)
    return mix64(np.concatenate([slice_hash(h, skipped + 1, skipped + 1 + n), slice_hash(h, whole, whole + n + 1)]))


def rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(prefix, whole, first) of a word's rotations: ``first`` is false where the character before equals the skipped one."""
    for i in range(len(word)):
        yield word[i + 1 :] + TERMINATOR + word[:i], False, i == 0 or word[i] != word[i - 1]
    for i in range(len(word) + 1):
        yield word[i:] + TERMINATOR + word[:i], True, True


def long_rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """The same with digests for prefixes; words of just ``LONG`` code points only meet longer ones here."""
    n = len(word)
    symbols = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    for i, (x, y) in enumerate(zip(_digests(symbols, 0x5BD1E995).tolist(), _digests(symbols, 0x27D4EB2F).tolist(), strict=True)):
        if n > LONG or i >= n:
            yield f"{x:016x}{y:016x}", i >= n, i >= n or i == 0 or word[i] != word[i - 1]


def _rotated(words: DataFrame, rotate) -> DataFrame:
    """(prefix, whole, first, word, n) of all rotations of ``words`` (text, word, n), where ``word`` stands for the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for text, word, n in zip(b["text"], b["word"], b["n"], strict=True):
                for found in rotate(text):
                    rows.append((*found, word, n))
                    if len(rows) >= BATCH_WORDS:
                        yield pd.DataFrame(rows, columns=["prefix", "whole", "first", "word", "n"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["prefix", "whole", "first", "word", "n"])

    return words.select("text", "word", "n").mapInPandas(run, "prefix string, whole boolean, first boolean, word string, n long")


def _scanned(rotated: DataFrame) -> DataFrame:
    """(word, n_near, m, w) of the words that share a range with others: minus the best one's n, and the best one."""
    span = Window.partitionBy("prefix").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))  # the least struct is the best word
    skips, firsts, shorter = F.when(~F.col("whole"), this), F.when(~F.col("whole") & F.col("first"), this), F.when(F.col("whole"), this)
    ranges = rotated.select(
        "*", F.count(skips).over(span).alias("skips"), F.count(firsts).over(span).alias("firsts"), F.min(shorter).over(span).alias("shorter"),
        F.min(skips).over(span).alias("best"), F.nth_value(skips, 2, ignoreNulls=True).over(span).alias("second"), F.min(firsts).over(span).alias("best_first"),
    )
    others = F.when(F.col("best.w") == F.col("word"), F.col("second")).otherwise(F.col("best"))
    here = F.when(F.col("whole"), F.col("best_first")).when(F.col("first"), F.least(others, "shorter")).otherwise(others)
    number = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("skips") - 1 + F.when(F.col("first") & F.col("shorter").isNotNull(), 1).otherwise(0))
    found = ranges.select("word", number.alias("n_near"), here.alias("best")).where("n_near > 0")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", "best.m", "best.w")


def near(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of ``words`` (word, n), whose words are distinct.

    ``form`` is the near word with the largest n (ties: the smallest), if that is at least twice the word's own.
    """
    size = F.char_length("word")
    found = _scanned(_rotated(words.where(size <= LONG).select(F.col("word").alias("text"), "word", "n"), rotations))
    long = words.where(size >= LONG)
    if not long.isEmpty():
        # long words go by their place in code-point order, so that a word isn't written once for each rotation
        placed = ranked(long.select(F.lit("").alias("g"), "word", F.col("n").alias("times")), ["word"], "spelling-long")
        number = F.lpad(F.col("i").cast("string"), 20, "0")
        names = placed.select(number.alias("number"), "word")
        apart = _scanned(_rotated(placed.select(F.col("word").alias("text"), number.alias("word"), F.col("times").alias("n")), long_rotations))
        named = apart.withColumnRenamed("word", "number").join(names, "number").drop("number")
        named = named.join(names.select(F.col("number").alias("w"), F.col("word").alias("best")), "w").select("word", "n_near", "m", F.col("best").alias("w"))
        both = found.unionByName(named).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", "w")).alias("best"))
        found = both.select("word", "n_near", "best.m", "best.w")
    good = -F.col("m") >= 2 * F.col("n")
    return words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("w")).alias("form"), F.when(good, -F.col("m")).alias("form_n")
    )


def roots(forms: DataFrame, label: str = "spelling") -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last word on the way from form to form.

    A form is at least twice as frequent as its word, so ways are short; each round doubles the steps.
    """
    stored = materialize(forms.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), f"{label}-steps")
    while not stored.where("moved").isEmpty():
        at = stored.select("word", "root")
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, stored = stored, materialize(stepped, f"{label}-steps")
        drop_table(before)
    return forms.join(stored.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``."""
    words = materialize(counts(docs), "spelling-words")
    forms = materialize(near(words), "spelling-forms")
    drop_table(words)
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
