"""Operator 6, token counts that follow edits.

A document is kept as its pre-tokens in blocks, under a segment tree whose nodes hold the number of
characters and tokens below them. An edit finds its place by descending the tree, splits anew only
from the last pre-token that can't see the edit up to the first old boundary behind it, counts only the
pre-tokens that are new, and updates the sums on the way up.

The pattern of pre-tokens looks at most ``LOOKAHEAD`` characters past a match and never back; so
pre-tokens that end that far before an edit stay, and from an old boundary on the old split holds.

Cases: null and empty texts have 0 tokens; places past the end are moved to the end, negative ones
to 0; a null edit list or null parts of an edit are no change; repeated rows are counted one by one;
an empty table gives an empty result. The text of a special token is ordinary text here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing

LOOKAHEAD = 2
BLOCK = 64
REACH = 256


class Document:
    """The segment tree of one text."""

    def __init__(self, text: str, words: tokenizing.Words):
        self.words = words
        self.reencoded = 0
        self._plant(words.cut(text))

    def _plant(self, pre: list[str]) -> None:
        self.blocks = [pre[i : i + BLOCK] for i in range(0, len(pre), BLOCK)] or [[]]
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.leaves, 2), np.int64)  # node -> characters, tokens
        for i, b in enumerate(self.blocks):
            self.sums[self.leaves + i] = self._weigh(b)
        step = self.leaves // 2
        while step:
            self.sums[step : 2 * step] = self.sums[2 * step : 4 * step : 2] + self.sums[2 * step + 1 : 4 * step : 2]
            step //= 2

    def _weigh(self, block: list[str]) -> tuple[int, int]:
        words = self.words
        return sum(map(len, block)), sum([len(words[w]) for w in block]) // 4

    def _update(self, i: int) -> None:
        node = self.leaves + i
        self.sums[node] = self._weigh(self.blocks[i])
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(w for b in self.blocks for w in b)

    def _find(self, at: int) -> tuple[int, int]:
        """(block, characters before it) of the block that holds the character ``at``."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= before + self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return min(node - self.leaves, len(self.blocks) - 1), before

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` on by ``inserted``."""
        size = int(self.sums[1, 0])
        at = min(max(at, 0), size)
        stop = min(at + max(removed, 0), size)
        if at == stop and not inserted:
            return
        first, before = self._find(max(0, at - LOOKAHEAD - 1))
        while first and sum(map(len, self.blocks[first])) + before > at - LOOKAHEAD and before > at - LOOKAHEAD:
            first -= 1
            before -= int(self.sums[self.leaves + first, 0])
        if first and (not self.blocks[first] or before + len(self.blocks[first][0]) + LOOKAHEAD > at):
            first -= 1
            before -= int(self.sums[self.leaves + first, 0])
        keep: list[str] = []
        begin = before
        for w in self.blocks[first]:
            if begin + len(w) + LOOKAHEAD > at:
                break
            keep.append(w)
            begin += len(w)
        last, end = self._find(min(stop, max(size - 1, 0)))
        end += int(self.sums[self.leaves + last, 0])
        old = [w for b in self.blocks[first : last + 1] for w in b]
        while True:
            fresh = self._split(old, before, begin, at, stop, inserted, last + 1 == len(self.blocks))
            if fresh is not None:
                break
            more = min(len(self.blocks), last + 1 + max(1, (last - first + 1)))
            old += [w for b in self.blocks[last + 1 : more] for w in b]
            last = more - 1
        new, tail = fresh
        self.reencoded += len(new)
        merged = keep + new + tail
        if len(merged) > 4 * BLOCK * (last - first + 1):
            self._plant([w for b in self.blocks[:first] for w in b] + merged + [w for b in self.blocks[last + 1 :] for w in b])
            return
        share = -(-len(merged) // (last - first + 1)) or 1
        for i in range(first, last + 1):
            self.blocks[i] = merged[(i - first) * share : (i - first + 1) * share]
            self._update(i)

    def _split(self, old: list[str], before: int, begin: int, at: int, stop: int, inserted: str, to_end: bool) -> tuple[list[str], list[str]] | None:
        """(new pre-tokens, old ones behind them), or None if more of the old text has to be seen."""
        text = "".join(old)
        seen = text[begin - before : at - before] + inserted + text[stop - before :]
        shift = len(inserted) - (stop - at)
        bounds, where = {}, before
        for i, w in enumerate(old):
            if where >= stop:
                bounds[where] = i
            where += len(w)
        out, pos, done = [], begin, at + len(inserted)
        reach = done - begin + REACH
        while True:
            part = seen[:reach]
            whole = reach >= len(seen) and to_end
            out, pos = [], begin
            for w in self.words.cut(part):
                if pos >= done and pos - shift in bounds:
                    return out, old[bounds[pos - shift] :]
                if not whole and pos + len(w) + LOOKAHEAD > begin + len(part):
                    break
                out.append(w)
                pos += len(w)
            else:
                if whole:
                    return out, []
            if reach >= len(seen) and not to_end:
                return None
            reach *= 2


def counts(docs: DataFrame, edits: str = "edits", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, edited_tokens, n_pretokens and reencoded (pre-tokens counted anew for the edits).

    ``edits`` is an array of (at, removed, inserted), applied in order to the text as it is then.
    """
    path = tokenizer or tokenizing.default_path()

    @F.pandas_udf("n_tokens long, edited_tokens long, n_pretokens long, reencoded long")
    def run(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        words, out = tokenizing.words(path), []
        for t, es in zip(texts, lists, strict=True):
            d = Document(t or "", words)
            before, pre = d.tokens, sum(map(len, d.blocks))
            for e in es if es is not None else ():
                if e is not None and e["at"] is not None:
                    d.edit(e["at"], e["removed"] or 0, e["inserted"] or "")
            out.append((before, d.tokens, pre, d.reencoded))
        return pd.DataFrame(out, columns=["n_tokens", "edited_tokens", "n_pretokens", "reencoded"])

    names = ("n_tokens", "edited_tokens", "n_pretokens", "reencoded")
    return docs.select(*[c for c in docs.columns if c not in names], run(F.col(text), F.col(edits)).alias("_c")).select("*", "_c.*").drop("_c")


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits that follow from each row: a replacement, a deletion and an appended copy of the start."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.greatest(F.coalesce(F.char_length("text"), F.lit(0)), F.lit(1)).cast("long")
    start = F.coalesce(F.substring("text", 1, 40), F.lit(""))
    edit = lambda at, removed, inserted: F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    return docs.withColumn("edits", F.array(edit(key % size, 25, start), edit((key * 31) % size, 12, F.lit("")), edit(size + 40, 0, F.concat(F.lit(" "), start))))
