"""Operator 3, chat formatting: transcripts become canonical turns by a hidden Markov model.

A state is a role with a place in the turn: its first line or a later one. Each line is described by
its speaker marker and by a few features of the line. Markers are free-form: any short head of a line
that looks like a speaker's name (``Name:``, ``[name]``, ``### Name``, ``<name>``, ``Name>``). Which of
them mean what is learned: heads that open turns in known transcripts form the lexicon, one emission
each; an unknown head counts as such, once or repeated within its transcript. Start, transition and
emission tables are counted from transcripts whose turns are known; every row of a table gets one more
count, shared out like the table's columns as a whole (each with ``SMOOTHING`` more), so that rarely seen
states behave like the average. Viterbi finds the likeliest states of a transcript's lines, a first-line
state opens a turn, its marker is cut off (if it is in the lexicon or repeated, or if other lines of the
transcript have heads) and the turns are rendered in one canonical form.

The lexicon is a trained table of at most ``LEXICON`` heads seen in ``SEEN`` transcripts or more; the names of
one conversation's speakers are unknown heads in training too. ``transcripts``
writes conversations as raw transcripts in several marker styles. Conversations are cut every ``TURNS``
turns, so that one endless conversation doesn't meet in one task.

Cases: a null text is an empty turn; a role other than system, user and assistant, null too, is ``other``
(written with its own name as marker, a null one without); a null turn sorts first; turns with one number
follow in order of role and text; repeated rows are turns of their own; very long texts are read whole, line
by line; an empty transcript has no turns and renders as ''; without anything to learn from all tables are
uniform; an empty table gives an empty result. Columns of the input named ``turns`` or ``rendered`` are
replaced by the output column, others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "other")
TURNS = 128
LEXICON, SEEN = 4096, 2
SMOOTHING = 0.1
#: Speaker markers that ``transcripts`` writes for the first three roles, by style. Reading doesn't use them.
MARKERS = {
    "system": ("System:", "SYSTEM:", "### System", "[system]", "Instructions:"),
    "user": ("User:", "Human:", "### User", "[user]", "Q:"),
    "assistant": ("Assistant:", "AI:", "### Assistant", "[assistant]", "A:"),
}
STYLES = len(MARKERS["user"])
#: Names for the style in which each conversation has its own speakers.
NAMES = ("Kim", "Lee", "Ana", "Ben", "Mia", "Tom", "Zoe", "Raj")
_HEAD = re.compile(r"(#{1,6} ?\w+:?|<\|?\w+\|?>|\[\w[\w ]{0,23}\]|\*\*\w[\w ]{0,23}:?\*\*:?|\w[\w .'-]{0,23}?[:>])(?=\s|$)")
#: Numbers of values of each line feature: head, length, ending, first character. Heads: none; unknown once; unknown repeated; none in a
#: loose transcript after a blank line, after another line, at the start; then the lexicon. Loose is a transcript in which fewer than
#: two lines have a head: there blank lines part the turns.
SHAPE = (6, 5, 4, 4)


def head(line: str) -> tuple[str, str]:
    """(the line's head that looks like a marker in lower case or '', the line without it)."""
    m = _HEAD.match(line)
    return (m[1].lower(), line[m.end() :].removeprefix(" ")) if m else ("", line)


def features(lines: list[str], lexicon: dict[str, int] | None = None) -> np.ndarray:
    """One row of feature values for each line; ``lexicon`` gives known heads their values."""
    out = np.zeros((len(lines), len(SHAPE)), np.int64)
    split = [head(line) for line in lines]
    often = Counter(form for form, _ in split)
    markers = [0 if not form else (lexicon or {}).get(form, 1 + (often[form] > 1)) for form, _ in split]
    loose = sum(m > 0 for m in markers) < 2
    after = 5  # start of the transcript
    for i, (line, (_, rest), marker) in enumerate(zip(lines, split, markers, strict=True)):
        body = (rest if marker >= 2 else line).strip()
        ending = 0 if not body else 1 if body[-1] == "?" else 2 if body[-1] in ".!" else 3
        first = 0 if not body else 1 if body[0].isupper() else 2 if body[0].islower() else 3
        out[i] = marker or loose * after, min(4, len(body).bit_length() // 2), ending, first
        after = 3 if not body else 4
    return out


@dataclass
class Model:
    """Log tables over the states 2 * role + (0 for a turn's first line, 1 for a later one)."""

    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]
    lexicon: dict[str, int] = field(default_factory=dict)

    def states(self, lines: list[str], x: np.ndarray | None = None) -> np.ndarray:
        """The likeliest states (Viterbi); ties go to the lower state."""
        if not lines:
            return np.zeros(0, np.int64)
        x = features(lines, self.lexicon) if x is None else x
        e = sum(table[:, x[:, f]].T for f, table in enumerate(self.emit))
        best = self.start + e[0]
        back = np.zeros((len(lines), len(best)), np.int64)
        for i in range(1, len(lines)):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + e[i]
        out = np.zeros(len(lines), np.int64)
        out[-1] = best.argmax()
        for i in range(len(lines) - 1, 0, -1):
            out[i - 1] = back[i][out[i]]
        return out

    def turns(self, transcript: str | None) -> list[tuple[str, str]]:
        """(role, text) of the turns of a raw transcript."""
        lines = (transcript or "").split("\n") if transcript else []
        x = features(lines, self.lexicon)
        heads = (x[:, 0] > 0) & ~np.isin(x[:, 0], (3, 4, 5))
        cut = heads & ((heads.sum() >= 2) | (x[:, 0] >= 2))
        out: list[tuple[str, list[str]]] = []
        for line, headed, state in zip(lines, cut, self.states(lines, x), strict=True):
            if state % 2 == 0 or not out:
                out.append((ROLES[state // 2], [head(line)[1] if headed else line]))
            else:
                out[-1][1].append(line)
        return [(role, "\n".join(body).strip("\n")) for role, body in out]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form of a conversation."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def learned_heads(known: DataFrame) -> dict[str, int]:
    """Heads that open a turn in most of the lines they stand at, the most frequent first (ties by their letters)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            opens, all_, seen = Counter(), Counter(), Counter()
            for text, states in zip(b["transcript"], b["states"], strict=True):
                forms = [(head(line)[0], int(state) % 2 == 0) for line, state in zip(text.split("\n"), states, strict=False)]
                all_.update(f for f, _ in forms if f)
                opens.update(f for f, first in forms if f and first)
                seen.update({f for f, _ in forms if f})
            yield pd.DataFrame([(f, seen[f], opens[f], n) for f, n in all_.items()], columns=["form", "seen", "opens", "n"])

    counts = known.select("transcript", "states").mapInPandas(count, "form string, seen long, opens long, n long").groupBy("form")
    kept = counts.agg(*[F.sum(c).alias(c) for c in ("seen", "opens", "n")]).where(f"seen >= {SEEN} and 2 * opens > n").orderBy(F.desc("opens"), "form").limit(LEXICON).collect()
    return {r["form"]: SHAPE[0] + i for i, r in enumerate(kept)}


def train(known: DataFrame) -> Model:
    """A model from (transcript, states) rows; only the lexicon and counts of its size leave the tasks."""
    lexicon = learned_heads(known)
    n, shape = 2 * len(ROLES), (SHAPE[0] + len(lexicon), *SHAPE[1:])
    sizes = [(1, n), (n, n), *[(n, k) for k in shape]]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros(s, np.int64) for s in sizes]
        for b in batches:
            for text, states in zip(b["transcript"], b["states"], strict=True):
                y, x = np.asarray(states, np.int64), features(text.split("\n"), lexicon)
                if len(y) != len(x) or not len(y):
                    continue
                tables[0][0, y[0]] += 1
                np.add.at(tables[1], (y[:-1], y[1:]), 1)
                for f in range(len(SHAPE)):
                    np.add.at(tables[2 + f], (y, x[:, f]), 1)
        flat = np.concatenate([t.ravel() for t in tables])
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": flat[at]})

    rows = known.select("transcript", "states").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(sum(a * b for a, b in sizes))
    flat[rows["cell"].to_numpy(np.int64)] += rows["n"].to_numpy(float)
    tables, at = [], 0
    for a, b in sizes:
        t = flat[at : at + a * b].reshape(a, b)
        whole = t.sum(axis=0) + SMOOTHING
        t = t + whole / whole.sum()
        tables.append(np.log(t / t.sum(axis=1, keepdims=True)))
        at += a * b
    return Model(tables[0][0], tables[1], tables[2:], lexicon)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, transcript, states, roles): raw transcripts of conversations with their true states.

    The style follows from conv_id. In style ``STYLES`` each conversation has speakers of its own names; in the last
    one only the first turn of a part has a marker and the others are set apart by blank lines.
    """
    draw = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary"))
    style = F.pmod(draw, F.lit(STYLES + 2)).cast("int")
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1, F.lit(-1))
    role = F.when(role < 0, len(ROLES) - 1).otherwise(role)
    marks = F.array(*[F.array(*map(F.lit, MARKERS[r])) for r in ROLES[:-1]])
    own = F.concat(F.initcap("role"), F.lit(":"))  # null for a null role
    base = conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(0)).cast("long").alias("part"),
        F.struct(F.col("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), own.alias("own")).alias("t"),
        style.alias("style"), draw.alias("draw"),
    )
    gathered = base.groupBy("conv_id", "part", "style", "draw").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    loose = F.col("style") == STYLES + 1
    fixed = lambda t: F.get(F.get(marks, t["role"]), F.col("style") % STYLES)
    name = lambda t: F.concat(F.get(F.array(*map(F.lit, NAMES)), ((F.col("draw").bitwiseXOR(t["role"])) % len(NAMES)).cast("int")), F.floor(F.col("draw") / 8) % 1000, F.lit(":"))
    mark = lambda t: F.when(t["role"] == len(ROLES) - 1, t["own"]).when(F.col("style") == STYLES, name(t)).otherwise(fixed(t))
    marked = lambda t, i: mark(t).isNotNull() & (~loose | (i == 0))
    written = F.transform("ts", lambda t, i: F.when(marked(t, i), F.concat(mark(t), F.lit(" "), t["text"])).otherwise(t["text"]))
    inner = lambda t, i: F.transform(
        F.sequence(F.lit(1), F.size(F.split(t["text"], "\n")) + F.when(~loose | (i == F.size("ts") - 1), 0).otherwise(1)),
        lambda k: t["role"] * 2 + F.when(k == 1, 0).otherwise(1),
    )
    return gathered.select(
        "conv_id", "part",
        F.when(loose, F.array_join(written, "\n\n")).otherwise(F.array_join(written, "\n")).alias("transcript"),
        F.flatten(F.transform("ts", inner)).alias("states"),
        F.transform("ts", lambda t: F.get(F.array(*map(F.lit, ROLES)), t["role"])).alias("roles"),
    )


def format_transcripts(raw: DataFrame, model: Model, text: str = "transcript") -> DataFrame:
    """``raw`` with turns (role, text) and their canonical rendering."""

    @F.pandas_udf("turns array<struct<role: string, text: string>>, rendered string")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [model.turns(t) for t in texts]
        return pd.DataFrame({"turns": [[{"role": r, "text": t} for r, t in f] for f in found], "rendered": [render(f) for f in found]})

    return raw.select(*[c for c in raw.columns if c not in ("turns", "rendered")], run(F.col(text)).alias("_r")).select("*", "_r.turns", "_r.rendered").drop("_r")
