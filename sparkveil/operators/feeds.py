"""Feed normalisers: raw lines become typed emissions, and lines that can't become rejects.

Every normaliser returns (emissions, rejects); one predicate decides, so a bad record never fails a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMITS = "key string, layer string, t long, lat double, lon double, alt double, name string, meta map<string,string>"


def finite(x: Column) -> Column:
    """A double, or null where it is not a finite number."""
    v = x.try_cast("double") if isinstance(x, Column) else F.col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def placed(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def split_good(rows: DataFrame, good: Column, reason: Column, raw: str) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, (record, reason) of the others)."""
    return rows.where(good), rows.where(~good).select(F.col(raw).alias("record"), reason.alias("reason"))


def earthquakes(raw: DataFrame, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """One GeoJSON feature a row: id, [lon, lat, depth km], properties mag, time (ms), place, ids."""
    schema = "id string, geometry struct<coordinates array<double>>, properties struct<mag double, time bigint, place string, ids string>"
    rows = raw.select("*", F.explode(F.array(F.from_json(text, schema))).alias("f"))  # parsed once, whatever reads it
    lon, lat, depth = (F.get("f.geometry.coordinates", F.lit(i)) for i in range(3))
    good = F.coalesce(F.col("f.id").isNotNull() & placed(lat, lon), F.lit(False))
    kept, rejects = split_good(rows, good, F.when(F.col("f.id").isNull(), "no id").otherwise("no position"), text)
    other = F.array_join(F.transform(F.filter(F.split("f.properties.ids", ","), lambda x: (x != "") & (x != F.col("f.id"))), lambda x: F.concat(F.lit("usgs:"), x)), ",")
    emits = kept.select(
        F.concat(F.lit("usgs:"), "f.id").alias("key"), F.lit("seismic").alias("layer"), (F.col("f.properties.time") / 1000).cast("bigint").alias("t"), lat.alias("lat"), lon.alias("lon"),
        (depth * -1000).alias("alt"), F.col("f.properties.place").alias("name"), F.col("f.properties.mag").alias("mag"), other.alias("supersedes"),
    )
    return emits, rejects


def fires(raw: DataFrame, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """CSV rows: latitude,longitude,brightness,date,hhmm,source,frp."""
    c = F.split(text, ",")
    rows = raw.select("*", finite(F.get(c, F.lit(0))).alias("lat"), finite(F.get(c, F.lit(1))).alias("lon"), finite(F.get(c, F.lit(2))).alias("brightness"), F.get(c, F.lit(3)).alias("day"), F.lpad(F.get(c, F.lit(4)), 4, "0").alias("hhmm"), F.get(c, F.lit(5)).alias("source"), finite(F.get(c, F.lit(6))).alias("frp"))
    kept, rejects = split_good(rows, placed(F.col("lat"), F.col("lon")), F.lit("bad coordinates"), text)
    key = F.format_string("firms:%s:%sT%s:%.4f,%.4f", "source", "day", "hhmm", "lat", "lon")
    t = F.unix_seconds(F.try_to_timestamp(F.concat("day", "hhmm"), F.lit("yyyy-MM-ddHHmm")))
    return kept.select(key.alias("key"), F.lit("fire").alias("layer"), t.alias("t"), "lat", "lon", "brightness", "frp"), rejects


def vessels(raw: DataFrame, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Position reports as JSON lines; sentinel values become null, heading falls back to course."""
    schema = "MessageType string, MetaData struct<MMSI bigint, ShipName string>, Message struct<PositionReport struct<Latitude double, Longitude double, Cog double, Sog double, TrueHeading int>>"
    parsed = raw.select("*", F.explode(F.array(F.from_json(text, schema))).alias("m"))  # parsed once, whatever reads it
    rows = parsed.select("*", F.col("m.MetaData.MMSI").alias("mmsi"), "m.MessageType", "m.Message.PositionReport.*", F.rtrim(F.regexp_replace("m.MetaData.ShipName", "[@\\x00]+", " ")).alias("name"))
    good = F.coalesce((F.col("MessageType") == "PositionReport") & F.col("mmsi").between(1, 999_999_999) & (F.abs("Latitude") <= 89.9) & (F.abs("Longitude") <= 180), F.lit(False))
    kept, rejects = split_good(rows, good, F.when(F.col("m.MessageType").isNull(), "malformed").otherwise("no position"), text)
    course = F.when(F.col("Cog") < 360, F.col("Cog"))
    return kept.select(
        F.concat(F.lit("ais:"), "mmsi").alias("key"), F.lit("maritime").alias("layer"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.nullif("name", F.lit("")).alias("name"),
        F.coalesce(F.when(F.col("TrueHeading") < 360, F.col("TrueHeading").cast("double")), course).alias("heading"), F.when(F.col("Sog") < 102.3, F.col("Sog")).alias("speed"),
    ), rejects


def aircraft(raw: DataFrame, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Receiver snapshots as JSON lines {now, aircraft: [...]}: one emission per aircraft with a position."""
    schema = "now double, aircraft array<struct<hex string, flight string, lat double, lon double, alt_baro string, gs double, seen_pos double, category string, squawk string>>"
    rows = raw.withColumn("s", F.from_json(text, schema)).select(text, F.col("s.now").alias("now"), F.explode_outer("s.aircraft").alias("a")).select(text, "now", "a.*")
    ground = F.col("alt_baro") == "ground"
    good = F.coalesce(F.col("hex").rlike("^~?[0-9a-f]{6}$") & placed(F.col("lat"), F.col("lon")) & ~F.coalesce(F.col("category").startswith("C"), F.lit(False)), F.lit(False))
    kept, rejects = split_good(rows, good, F.when(~F.col("hex").rlike("^~?[0-9a-f]{6}$"), "bad address").otherwise("no position"), text)
    return kept.select(
        F.concat(F.lit("aviation:"), "hex").alias("key"), F.lit("aviation").alias("layer"), F.floor(F.col("now") - F.coalesce("seen_pos", F.lit(0.0))).cast("bigint").alias("t"), "lat", "lon",
        F.when(~ground, F.round(F.col("alt_baro").try_cast("double") * 0.3048, 1)).alias("alt"), F.nullif(F.trim("flight"), F.lit("")).alias("name"), F.coalesce(ground, F.lit(False)).alias("on_ground"),
        F.col("squawk").isin("7500", "7600", "7700").alias("emergency"),
    ), rejects


def indicator_lines(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Indicators of list lines: comments and loopback names skipped, hosts-file lines give the name, trailing
    notes cut; each is classified as url, network, ip, hash or host."""
    line = F.trim(F.regexp_replace(F.col(text), r"\s+#.*$", ""))
    token = F.when(line.rlike(r"^(?:0\.0\.0\.0|127\.0\.0\.1)\s+\S"), F.regexp_extract(line, r"^\S+\s+(\S+)", 1)).otherwise(F.regexp_extract(line, r"^(\S+)", 1))
    rows = raw.withColumn("token", token).where(~line.rlike(r"^(?:#|;|//)") & (token != "") & ~token.isin("localhost", "localhost.localdomain", "broadcasthost"))
    t = F.col("token")
    kind = F.when(t.rlike("^[a-z]+://"), "url").when(t.rlike(r"^[0-9.]+/[0-9]+$"), "network").when(t.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip").when(t.rlike("^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), "hash").otherwise("host")
    return rows.withColumn("kind", kind).withColumn("key", F.when(kind == "url", t).otherwise(F.lower(t)))


def mixed_time(text: Column) -> Column:
    """Epoch seconds of epoch s or ms, yyyyMMddHHmmss, yyyyMMdd, ISO and d/m/Y times; null for others."""
    number = F.when(text.rlike("^[0-9]{9,10}$"), text.try_cast("bigint")).when(text.rlike("^[0-9]{13}$"), F.floor(text.try_cast("bigint") / 1000).cast("bigint"))
    formats = (("^[0-9]{14}$", "yyyyMMddHHmmss"), ("^[0-9]{8}$", "yyyyMMdd"), ("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"), ("^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"))
    return F.coalesce(number, *[F.when(text.rlike(p), F.unix_seconds(F.try_to_timestamp(text, F.lit(f)))) for p, f in formats])


def missed_slots(seen: DataFrame, until: int, step_s: int = 900, most: int = 8) -> DataFrame:
    """The next ``most`` export slots after each feed's last one, up to ``until``."""
    first = (F.floor(F.col("last_t") / step_s).cast("bigint") + 1) * step_s
    slots = F.sequence(first, F.greatest(first, F.lit(until).cast("bigint")), F.lit(step_s).cast("bigint"))
    return seen.select("module", F.explode(F.slice(slots, F.lit(1), F.lit(most))).alias("slot")).where(F.col("slot") <= until)
