"""Operator 11, Merkle dataset manifest: hash trees of rows per group, a root over all groups, and proofs.

A level is one aggregation: the children of a parent are spread into ``FANOUT`` columns by conditional
aggregates (child ``i`` of a group stands in slot ``i % FANOUT`` of parent ``i / FANOUT``). All columns
concatenated hash to the parent; without a slot's own column they are that child's siblings. Going down
again, every node takes its siblings and those of its ancestors from its parent's row, so a proof needs
no walk. The groups' subroots, in order of their key, are the leaves of a second tree of the same kind.

Rows are numbered within their group by ranges of (group, order) and counts per range, so a group of any
size is numbered, hashed and proved in parallel.

Cases: a null is hashed as ``-``, an empty text as ``0:``, so they differ; a null group is a group of
its own, the first; a group of one row has that row's leaf as its subroot; equal keys are ordered by
their leaf, equal rows have equal leaves and each its own slot and proof; texts of any length are hashed
whole and only digests are shuffled; extra columns are not part of a leaf and don't come back, whatever
their names; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, parts

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(inputs: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(inputs.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns.values()]))


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` (g, ...) with ``i``, the place in its group by ``order`` from 0, and ``n``, the group's rows.

    The numbering is stored, so that it stays as it is when a task runs again.
    """
    spread = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows of a hot key go to several ranges
    dealt = materialize(spread.repartitionByRange(parts(rows.sparkSession), "g", *order, "salt").withColumn("r", F.spark_partition_id()), f"{label}-ranges")
    counts = dealt.groupBy("g", "r").agg(F.count("*").alias("k"))
    before = counts.selectExpr("g", "r", "sum(k) over (partition by g order by r) - k as base", "sum(k) over (partition by g) as n")
    numbered = dealt.join(before, ["g", "r"]).withColumn("at", F.expr(f"row_number() over (partition by g, r order by {', '.join(order)}, salt)"))
    out = materialize(numbered.select(*rows.columns, (F.col("base") + F.col("at") - 1).alias("i"), "n"), label)
    drop_table(dealt)
    return out


_SLOTS = [f"c{s}" for s in range(FANOUT)]


def _joined(slots: list[str]) -> str:
    """Expression of the digests in the slots' columns, one after the other."""
    return "concat('', " + ", ".join(f"coalesce({c}.h, '')" for c in slots) + ")" if slots else "''"


def pivoted(nodes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each parent of ``nodes`` (g, i, n, h): (g, i, n, h, c0 to c15), i and n of the next level.

    A slot's column is a struct of its child's ``h`` and the ``carried`` columns, or null.
    """
    child = f"struct({', '.join(('h', *carried))})"
    spread = nodes.groupBy("g", F.floor(F.col("i") / FANOUT).cast("long").alias("parent")).agg(
        *[F.expr(f"max(if(i % {FANOUT} = {s}, {child}, null)) as {c}") for s, c in enumerate(_SLOTS)],
        F.ceil(F.max("n") / FANOUT).cast("long").alias("n"),
    )
    return spread.select("g", F.col("parent").alias("i"), "n", digest(F.expr(_joined(_SLOTS))).alias("h"), *_SLOTS)


def children(parents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``c`` for each child of ``parents``: its slot ``s``, its columns, and the others' to its left and right."""
    of = lambda s, c: f"if({c} is null, null, struct({s} as s, {_joined(_SLOTS[:s])} as l, {_joined(_SLOTS[s + 1 :])} as r, {c} as of))"
    return parents.selectExpr(*keep, f"explode(array_compact(array({', '.join(of(s, c) for s, c in enumerate(_SLOTS))}))) as c")


def _height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


_PATH = "array<struct<l: string, r: string>>"


def longer() -> Column:
    """The path of child ``c``, from its own siblings on."""
    return F.concat(F.array(F.struct("c.l", "c.r")), "path").cast(_PATH)


class Tree:
    """All levels above the ranked leaves of every group, stored level by level."""

    def __init__(self, leaves: DataFrame, label: str, carried: tuple[str, ...] = ()):
        self.leaves, self.label, self.levels = leaves, label, []
        most = leaves.agg(F.max("n")).first()[0] or 0
        nodes = leaves
        for level in range(_height(most)):
            nodes = materialize(pivoted(nodes.where("n > 1"), carried=carried if level == 0 else ()), f"{label}-level")
            self.levels.append(nodes)

    def roots(self) -> DataFrame:
        """(g, h) of every group."""
        out = self.leaves.where("n = 1").select("g", "h")
        for nodes in self.levels:
            out = out.unionByName(nodes.where("n = 1").select("g", "h"))
        return out

    def paths(self, above: DataFrame | None = None) -> list[DataFrame]:
        """For each level from 1 up, (g, i, path, ...): siblings of a node and its ancestors, from the node up.

        ``above``: (g, path, ...) of the groups' own roots: paths go on from there, further columns go down with them.
        """
        start = lambda nodes: nodes.where("n = 1").select("g", "i").join(above, "g")
        if above is None:
            start = lambda nodes: nodes.where("n = 1").select("g", "i", F.array().cast(_PATH).alias("path"))
        further = [c for c in above.columns if c not in ("g", "path")] if above is not None else []
        out: list[DataFrame] = []
        higher = None
        for nodes in reversed(self.levels):
            own = start(nodes)
            if higher is not None:
                own = own.unionByName(higher)
            own = materialize(own, f"{self.label}-paths")
            out.append(own)
            if nodes is not self.levels[0]:
                below = children(nodes.join(own, ["g", "i"]), ["g", "i", "path", *further])
                higher = below.select("g", (F.col("i") * FANOUT + F.col("c.s")).alias("i"), longer().alias("path"), *further)
        return out[::-1]


def fold(start: Column, path: Column) -> Column:
    """The root that a node's digest and its siblings, level by level, lead to."""
    return F.aggregate(path, start, lambda h, side: digest(F.concat(side["l"], h, side["r"])))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, left to right, level by level."""
    return digest(F.array_join(F.transform(path, lambda side: F.concat(side["l"], side["r"])), ""))


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``folded_root`` starts from the leaf of the row with ``tampered_text`` instead of its text.
    """
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # null first, then bytewise
    told = leaf(columns)
    other = leaf(columns | {"text": tampered_text}) if tampered_text is not None else told
    rows = docs.select(key.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), told.alias("h"), other.alias("t"))
    tree = Tree(ranked(rows, ["doc_id", "h", "t"], "merkle-leaves"), "merkle", ("doc_id", "t"))
    groups = tree.roots().select(F.lit("").alias("g"), F.col("g").alias("source"), "h")
    top = Tree(ranked(groups, ["source"], "merkle-subroots"), "merkle-top", ("source",))
    last = top.roots().first()
    root = F.lit(last["h"] if last else None).cast("string")
    above = top.leaves.where("n = 1").select(F.col("source").alias("g"), F.col("h").alias("subroot"), F.array().cast(_PATH).alias("path"))
    if top.levels:
        child = children(top.levels[0].join(top.paths()[0], ["g", "i"]), ["path"])
        above = above.unionByName(child.select(F.col("c.of.source").alias("g"), F.col("c.of.h").alias("subroot"), longer().alias("path")))
    above = materialize(above, "merkle-groups")
    own = tree.leaves.where("n = 1").join(above, "g").select("doc_id", F.col("h").alias("leaf"), "t", "subroot", "path")
    if tree.levels:
        child = children(tree.levels[0].join(tree.paths(above)[0], ["g", "i"]), ["subroot", "path"])
        own = own.unionByName(child.select("c.of.doc_id", F.col("c.of.h").alias("leaf"), F.col("c.of.t").alias("t"), "subroot", longer().alias("path")))
    folded = own.withColumn("root", root).withColumn("folded_root", fold(F.col("t"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_cased(every: int = 5) -> Column:
    """The text, of every fifth row by crc32 of its id with A-Z lower-cased; a null id counts as the empty string."""
    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % every == 0
    return F.when(changed, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
