"""Aircraft states from positional arrays, and the track rows that states become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Knots and feet a minute of a metre a second, metres of a foot, and seconds after which a position is stale.
KNOTS, FEET_A_MINUTE, FOOT, STALE_S = 1.943844, 196.850394, 0.3048, 60
#: Position sources by their number, and bits of the database flags.
POSITION_SOURCES = ("adsb", "asterix", "mlat", "flarm")
FLAG_BITS = {"military": 1, "interesting": 2, "pia": 4, "ladd": 8}


def states(snapshots: DataFrame) -> DataFrame:
    """Aircraft of ``snapshots`` (line: JSON with time and states, arrays addressed by place).

    Rows without position, id or time, short rows, positions over ``STALE_S`` older than the snapshot, and surface
    vehicles and obstacles (categories 16 to 20) go.
    """
    x = F.from_json("line", "time double, states array<array<string>>")
    rows = snapshots.withColumn("_x", x).select(*[c for c in snapshots.columns if c != "line"], F.col("_x.time").alias("_now"), F.explode("_x.states").alias("_s"))
    at = lambda i: F.get("_s", F.lit(i))
    num = lambda i: at(i).try_cast("double")
    text = lambda i: F.nullif(F.trim(at(i)), F.lit(""))
    found = rows.where(F.size("_s") >= 17).select(
        *[c for c in snapshots.columns if c != "line"], "_now", F.lower(F.trim(at(0))).alias("hex"), text(1).alias("callsign"), text(2).alias("country"), num(3).alias("t"), num(6).alias("lat"), num(5).alias("lon"),
        (at(8) == "true").alias("on_ground"), num(13).alias("alt_geom_m"), num(7).alias("alt_baro_m"), F.round(num(9) * KNOTS, 3).alias("speed_kt"), num(10).alias("track"), F.round(num(11) * FEET_A_MINUTE, 3).alias("climb_fpm"), text(14).alias("squawk"),
        F.coalesce(F.get(F.array(*[F.lit(s) for s in POSITION_SOURCES]), at(16).try_cast("int")), F.lit("other")).alias("source"), at(17).try_cast("int").alias("_kind"),
    )
    real = F.col("hex").rlike("^~?[0-9a-f]{6}$") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("_now") - F.col("t") <= STALE_S)
    return found.where(real & ~F.coalesce(F.col("_kind").between(16, 20), F.lit(False))).drop("_now", "_kind")


def track_rows(aircraft: DataFrame, feed: str) -> DataFrame:
    """Track emissions of aircraft states.

    The altitude is the geometric one, else the barometric one, and none on the ground; the name is the callsign, else the
    registration, else the hex id; ids that are no address (~) are told apart by feed; flags become booleans.
    """
    alt = F.when(~F.coalesce("on_ground", F.lit(False)), F.coalesce("alt_geom_m", "alt_baro_m"))
    key = F.concat(F.lit("aviation:"), "hex", F.when(F.col("hex").startswith("~"), F.lit(f"@{feed}")).otherwise(""))
    bits: list[Column] = [(F.col("flags").bitwiseAND(b) != 0).alias(n) for n, b in FLAG_BITS.items()]
    return aircraft.select(key.alias("key"), F.coalesce("callsign", "registration", "hex").alias("name"), "t", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round(alt, 1).alias("alt"), *bits)
