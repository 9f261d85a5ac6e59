"""Ordered folds, dimension joins, sorts and set operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import WGS84_A, WGS84_F

#: Precision ranks with their radius in metres, and whether a map pin is allowed.
PRECISION = (("exact", 0, 0.0, True), ("rooftop", 1, 15.0, True), ("street", 2, 150.0, True), ("city", 3, 15_000.0, False), ("region", 4, 150_000.0, False), ("country", 5, 600_000.0, False))
#: Preference of position sources when two fixes of an aircraft are a second apart or less.
SOURCE_RANK = {"adsb": 0, "mlat": 1, "tisb": 2, "other": 3}


def merged_tracks(fixes: DataFrame) -> DataFrame:
    """One row per aircraft, however long it is followed: a fix replaces the one before if it is more than a second newer,
    or within a second from a better source; fields that it lacks keep their last value; flags are united.

    Fixes stream through the fold sorted by track and arrival, one running fix at a time; a track is one task's
    work, but never held in memory.
    """
    schema = "id string, seq long, t long, lat double, lon double, name string, flags long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, now = None, None
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                rank = SOURCE_RANK.get(x.source, 9)
                name = None if pd.isna(x.name) else x.name
                if track is None or x.id != track:
                    if track is not None:
                        out.append((track, *now[:2], *now[3:]))
                    track, now = x.id, [x.seq, x.t, rank, x.lat, x.lon, name, x.flags]
                    continue
                if x.t > now[1] + 1 or (abs(x.t - now[1]) <= 1 and rank < now[2]):
                    now = [x.seq, x.t, rank, x.lat, x.lon, name if name is not None else now[5], now[6] | x.flags]
                else:
                    now[5], now[6] = now[5] if now[5] is not None else name, now[6] | x.flags
            yield pd.DataFrame(out, columns=["id", "seq", "t", "lat", "lon", "name", "flags"])
        if track is not None:
            yield pd.DataFrame([(track, *now[:2], *now[3:])], columns=["id", "seq", "t", "lat", "lon", "name", "flags"])

    rows = fixes.where("id is not null").select("id", "seq", "t", "lat", "lon", "name", "flags", "source").repartition("id").sortWithinPartitions("id", "seq")
    return rows.mapInPandas(run, schema)


def tiers(readings: DataFrame, up: int = 10, hold: int = 7) -> DataFrame:
    """Final tier of each tile by hysteresis: promoted at once, demoted after two lower readings in a row; hot
    stays hot from ``hold`` on.

    Readings (tile, at, n) stream through the fold sorted by tile and time, one running state at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, tier, low, seen = None, 0, 0, 0
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                if seen and x.tile != tile:
                    out.append((tile, tier, seen))
                    tier, low, seen = 0, 0, 0
                tile, seen = x.tile, seen + 1
                want = 2 if x.n >= up or (tier == 2 and x.n >= hold) else int(x.n >= 1)
                low = low + 1 if want < tier else 0
                if want > tier or low >= 2:
                    tier, low = want, 0
            yield pd.DataFrame(out, columns=["tile", "tier", "readings"])
        if seen:
            yield pd.DataFrame([(tile, tier, seen)], columns=["tile", "tier", "readings"])

    kind = readings.schema["tile"].dataType.simpleString()
    rows = readings.where("tile is not null").select("tile", "at", "n").repartition("tile").sortWithinPartitions("tile", "at", "n")
    return rows.mapInPandas(run, f"tile {kind}, tier int, readings int")


def known_flags(fixes: DataFrame) -> DataFrame:
    """Fixes with all flags ever seen for their track."""
    return fixes.join(fixes.groupBy("id").agg(F.bit_or("flags").alias("all_flags")), "id")


def geodetic(x: str, y: str, z: str, rounds: int = 12) -> tuple[Column, Column, Column]:
    """(latitude, longitude, altitude) of earth-centred coordinates, by a fixed point on the latitude."""
    e2 = WGS84_F * (2 - WGS84_F)
    p = F.sqrt(F.col(x) ** 2 + F.col(y) ** 2)
    normal = lambda a: F.lit(WGS84_A) / F.sqrt(1 - e2 * F.sin(a) ** 2)
    first = F.atan2(F.col(z), p * (1 - e2))
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda a, _: F.atan2(F.col(z) + e2 * normal(a) * F.sin(a), p))
    return F.degrees(lat), F.degrees(F.atan2(F.col(y), F.col(x))), p * F.cos(lat) + F.col(z) * F.sin(lat) - F.lit(WGS84_A) * F.sqrt(1 - e2 * F.sin(lat) ** 2)


def parsed_position(text: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of ``48.85, 2.35`` and ``48.85N 2.35E``; null outside the ranges."""
    pattern = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([NSns]?)[\s,]+(-?[0-9]+(?:\.[0-9]+)?)\s*([EWew]?)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    lat = part(1).try_cast("double") * F.when(F.upper(part(2)) == "S", -1.0).otherwise(1.0)
    lon = part(3).try_cast("double") * F.when(F.upper(part(4)) == "W", -1.0).otherwise(1.0)
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, lat), F.when(ok, lon)


def radius_precision(radius_km: Column) -> Column:
    """Precision that an accuracy radius allows."""
    return F.when(radius_km <= 0.15, "street").when(radius_km <= 15, "city").when(radius_km <= 150, "region").otherwise("country")


def with_precision(df: DataFrame) -> DataFrame:
    """Rank, radius and pin rule of each row's precision; the dimension has six fixed rows."""
    dim = df.sparkSession.createDataFrame([*PRECISION], "precision string, rank int, radius_m double, pin boolean")
    return df.join(F.broadcast(dim), "precision", "left")


def consumers(types: DataFrame, modules: DataFrame, most: int) -> DataFrame:
    """The first ``most`` active modules that accept each type, by priority, then id."""
    accepts = modules.where("status <> 'retired'").select("module", "priority", F.explode("consumes").alias("type"))
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.col("priority").desc(), "module"))
    return types.join(accepts, "type").withColumn("place", place).where(F.col("place") <= most).select("type", "module", "place")


def coverage(modules: DataFrame) -> DataFrame:
    """Modules by phase and status with totals over each phase and over all."""
    return modules.rollup("phase", "status").agg(F.count("*").alias("modules"))


def outermost(spans: DataFrame) -> DataFrame:
    """Spans (key, lo, hi) that no earlier and wider span of their key encloses: one ordered running maximum."""
    before = Window.partitionBy("key").orderBy("lo", F.col("hi").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return spans.distinct().withColumn("_m", F.max("hi").over(before)).where("_m is null or hi > _m").drop("_m")


def truncated(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows in order, and whether there are more."""
    rows = df.orderBy(*order).limit(limit + 1)
    return rows.withColumn("more", F.count("*").over(Window.partitionBy()) > limit).orderBy(*order).limit(limit)


#: Features in one message at most.
MESSAGE_FEATURES = 500


def layer_deltas(writes: DataFrame, longest: int = 512, most: int = MESSAGE_FEATURES, parts: int = 16) -> DataFrame:
    """Messages of ``most`` changed features at most per (layer, batch): of rows with one id the last wins field by field.

    Up to ``most`` features are one message; more are dealt to ``parts`` by their id and cut there, so that no task holds
    or sorts all features of a layer.

    ``writes`` has batch, layer, id, seq and props (map of strings); values over ``longest`` characters are left out.
    """
    short = F.map_filter("props", lambda k, v: v.isNotNull() & (F.length(v) <= longest))
    fields = writes.select("batch", "layer", "id", "seq", F.explode_outer(short).alias("k", "v"))
    last = fields.groupBy("batch", "layer", "id", "k").agg(F.max_by("v", "seq").alias("v"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["k"].isNotNull())
    features = last.groupBy("batch", "layer", "id").agg(F.map_from_entries(kept).alias("props"))
    size = features.groupBy("batch", "layer").agg((F.count("*") > most).alias("_large"))
    dealt = features.join(size, ["batch", "layer"]).withColumn("_part", F.when(F.col("_large"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(0))
    place = F.row_number().over(Window.partitionBy("batch", "layer", "_part").orderBy("id"))
    cut = dealt.withColumn("_piece", F.floor((place - 1) / most))
    messages = cut.groupBy("batch", "layer", "_part", "_piece")
    return messages.agg(F.count("*").alias("features"), F.to_json(F.array_sort(F.collect_list(F.struct("id", F.to_json("props").alias("props"))))).alias("message")).drop("_part", "_piece")
