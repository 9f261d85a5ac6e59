"""State tables in batch form: revisions, tracks, history, entities, graphs and sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEEK_S = 7 * 86_400
HISTORY_GAP_S = 30


def last_per_key(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order; combined map-side, no sort of the groups."""
    rest = [c for c in events.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*events.columns)


def revised(events: DataFrame, window_s: int = WEEK_S) -> DataFrame:
    """Stored events after upserts by (key, t), revisions and supersedes.

    A later batch that writes a key removes that key's other times within the window; the keys that an
    emission supersedes go in its layer within the window, unless they came with the same batch or later.
    Removals are found with ordered windows by key: for each stored time the last batch that writes the key
    near it.
    """
    stored = last_per_key(events, ["key", "t"], ["batch", "seq"])
    near = f"over (partition by key order by t range between {window_s} preceding and {window_s} following)"
    kept = stored.selectExpr("*", f"max(batch) {near} as newest").where("newest <= batch").drop("newest")
    width = F.lit(max(1, window_s))
    cuts = events.where("supersedes is not null").groupBy(F.col("supersedes").alias("key"), "layer", F.col("t").alias("cut_t")).agg(F.max("batch").alias("cut_batch"))
    # a cut stands in its own span of time and in the two beside it, so that a stored event meets it in its own
    near_by = cuts.withColumn("_span", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("cut_t") / width) + d))).alias("c")
    k = kept.withColumn("_span", F.floor(F.col("t") / width)).alias("k")
    same = (F.col("k.key") == F.col("c.key")) & (F.col("k.layer") == F.col("c.layer")) & (F.col("k._span") == F.col("c._span"))
    later = (F.abs(F.col("c.cut_t") - F.col("k.t")) <= window_s) & (F.col("c.cut_batch") > F.col("k.batch"))
    return k.join(near_by, same & later, "left_anti").select(*events.columns)


def record_setters(fixes: DataFrame) -> DataFrame:
    """Fixes whose time is not older than any that arrived before them, by track."""
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return fixes.withColumn("_m", F.max("t").over(before)).where("_m is null or t >= _m").drop("_m")


def advanced(fixes: DataFrame) -> DataFrame:
    """Fixes whose time is newer than all that arrived before them, by track."""
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return fixes.withColumn("_m", F.max("t").over(before)).where("_m is null or t > _m").drop("_m")


def track_state(fixes: DataFrame) -> DataFrame:
    """One row per track: position and altitude of the newest accepted fix (altitude may be null), the last
    known name, heading and speed."""
    ok = record_setters(fixes)
    newest = F.max_by(F.struct("t", "lat", "lon", "alt"), "seq").alias("n")
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("name", "heading", "speed")]
    return ok.groupBy("id").agg(newest, *known).select("id", "n.*", "name", "heading", "speed")


def position_history(fixes: DataFrame) -> DataFrame:
    """The first fix that arrived for each (time, track)."""
    rest = [c for c in fixes.columns if c not in ("id", "t")]
    return fixes.groupBy("id", "t").agg(F.min_by(F.struct(*rest), "seq").alias("_r")).select("id", "t", "_r.*").select(*fixes.columns)


def downsampled(fixes: DataFrame, gap_s: int = HISTORY_GAP_S) -> DataFrame:
    """Fixes at least ``gap_s`` after the last kept one, in order of arrival, by track.

    Greedy keeping depends on the last kept fix, so it is a fold; rows stream through it sorted by track and
    arrival, one running value at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, kept = None, None
        for b in batches:
            keep = []
            for i, t in zip(b["id"], b["t"], strict=True):
                if i != track:
                    track, kept = i, None
                ok = kept is None or t - kept >= gap_s
                if ok:
                    kept = t
                keep.append(ok)
            yield b[keep]

    rows = fixes.repartition("id").sortWithinPartitions("id", "seq")
    return rows.mapInPandas(run, fixes.schema)


def entities(emissions: DataFrame) -> DataFrame:
    """Entities by (type, value): highest confidence, first and last time, latest known position, merged
    metadata (the last value of each key)."""
    located = F.when(F.col("lat").isNotNull(), F.struct("t", "seq"))
    base = emissions.groupBy("type", "value").agg(
        F.max("confidence").alias("confidence"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("observations"),
        F.max_by("lat", located).alias("lat"), F.max_by("lon", located).alias("lon"),
    )
    last = emissions.groupBy("type", "value", "meta_key").agg(F.max_by("meta_value", "seq").alias("v"))
    meta = last.groupBy("type", "value").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "meta_key", "v"))), ";").alias("meta"))
    return base.join(meta, ["type", "value"])


def edges(relations: DataFrame) -> DataFrame:
    """Relations by (src, dst, rel, module) with the highest confidence."""
    return relations.groupBy("src", "dst", "rel", "module").agg(F.max("confidence").alias("confidence"))


def degrees(relations: DataFrame) -> DataFrame:
    """Number of distinct edges at each node."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def subgraph(nodes: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """Edges among the ``limit`` newest nodes (id, seen), with the degree of the source in the result."""
    kept = nodes.orderBy(F.col("seen").desc(), "id").limit(limit).select("id")
    inside = relations.join(kept, F.col("src") == kept["id"], "left_semi").join(kept, F.col("dst") == kept["id"], "left_semi")
    return inside


def k_hop(seeds: DataFrame, relations: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` edges of the seeds and the least number of edges."""
    both = relations.selectExpr("src as a", "dst as b").union(relations.selectExpr("dst as a", "src as b")).distinct()
    found = seeds.select(F.col("id").alias("node"), F.lit(0).alias("hops"))
    frontier = found
    for k in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = step.join(found, "node", "left_anti").withColumn("hops", F.lit(k))
        found = found.union(frontier)
    return found


def reconciled(snapshot: DataFrame, deltas: DataFrame, asked_at: int) -> DataFrame:
    """A snapshot (id, t, v) brought up to date with deltas: the newer time wins; an id that the snapshot lacks
    stays only if its delta came after the snapshot was asked for."""
    s, d = snapshot.selectExpr("id", "t as st", "v as sv"), deltas.selectExpr("id", "t as dt", "v as dv")
    both = s.join(d, "id", "full_outer").where(f"st is not null or dt > {asked_at}")
    newer = F.col("st").isNull() | (F.col("dt") > F.col("st"))
    pick = lambda a, b: F.when(F.coalesce(newer, F.lit(False)), F.col(b)).otherwise(F.col(a))
    return both.select("id", pick("st", "dt").alias("t"), pick("sv", "dv").alias("v"))


def expired(states: DataFrame, as_of: int, max_age_s: int) -> DataFrame:
    """States seen within ``max_age_s`` before ``as_of``."""
    return states.where(F.col("t") >= as_of - max_age_s)


def first_emissions(emissions: DataFrame) -> DataFrame:
    """(type, value, run, seq): the earliest run that emitted a value, and its first row there."""
    first = emissions.groupBy("type", "value").agg(F.min(F.struct("run", "seq")).alias("_f"))
    return first.select("type", "value", F.col("_f.run").alias("first_run"), F.col("_f.seq").alias("first_seq"))


def resolved_parents(emissions: DataFrame) -> DataFrame:
    """Each emission with the first emission of its value in any strictly earlier run; missing if there is none."""
    first = first_emissions(emissions)
    e, f = emissions.alias("e"), first.alias("f")
    joined = e.join(f, F.col("e.type").eqNullSafe(F.col("f.type")) & F.col("e.value").eqNullSafe(F.col("f.value")))
    parent = F.when(F.col("f.first_run") < F.col("e.run"), F.col("f.first_seq"))
    return joined.select("e.seq", "e.type", "e.value", parent.alias("parent_seq"), parent.isNull().alias("missing"))


def first_seen(emissions: DataFrame) -> DataFrame:
    """Emissions whose value no strictly earlier run emitted."""
    return resolved_parents(emissions).where("missing").select("seq", "type", "value")
