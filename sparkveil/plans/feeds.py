"""Queries of the feed normalisers; the raw lines are written from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds as f
from ..sources import bindings as b
from .registry import query, sql

_LAT, _LON = "cast((event_id * 7919) % 19000 as double) / 100::double - 95::double", "cast((event_id * 104729) % 36000 as double) / 100::double - 180::double"


def _positions(spark, sf):
    return positions_of(b.load(spark, sf, "events"))


def positions_of(events):
    return events.selectExpr("event_id", "unix_seconds(cast(ts as timestamp)) as t", "value", "user_id", "cast((event_id * 7919) % 19000 as double) / 100D - 95D as lat", "cast((event_id * 104729) % 36000 as double) / 100D - 180D as lon")


def _quakes(spark, sf):
    p = _positions(spark, sf)
    feature = F.struct(
        F.when(F.col("event_id") % 13 > 0, F.concat(F.lit("us"), "event_id")).alias("id"),
        F.struct(F.array("lon", "lat", F.col("value") / 10).alias("coordinates")).alias("geometry"),
        F.struct(F.col("value").alias("mag"), (F.col("t") * 1000).alias("time"), F.concat(F.lit("near "), "user_id").alias("place"), F.expr("concat(',us', event_id, ',ci', user_id, ',')").alias("ids")).alias("properties"),
    )
    return p.select(F.when(F.col("event_id") % 17 > 0, F.to_json(feature)).otherwise(F.lit("{broken")).alias("raw"))


@query("a1_earthquakes", f"""select 'usgs:us' || event_id as key, 'seismic' as layer, epoch_us(ts) // 1000000 as t, lat, lon, value / 10 * -1000 as alt, 'near ' || user_id as name, value as mag, 'usgs:ci' || user_id as supersedes
    from (select *, {_LAT} as lat, {_LON} as lon from events) where event_id % 13 > 0 and event_id % 17 > 0 and lat between -90 and 90""")
def quakes(spark, sf):
    return f.earthquakes(_quakes(spark, sf))[0].select("key", "layer", "t", "lat", "lon", "alt", "name", "mag", "supersedes")


@query("a27_reject_channel", f"""select case when event_id % 13 = 0 or event_id % 17 = 0 then 'no id' else 'no position' end as reason, count(*) as records from (select *, {_LAT} as lat from events)
    where event_id % 13 = 0 or event_id % 17 = 0 or lat not between -90 and 90 group by 1""")
def rejects(spark, sf):
    return f.earthquakes(_quakes(spark, sf))[1].groupBy("reason").agg(F.count("*").alias("records"))


@query("a2_fires", f"""select printf('firms:VIIRS:2024-01-%02dT%04d:%.4f,%.4f', 1 + event_id % 28, (event_id % 24) * 100 + event_id % 60, lat, lon) as key, 'fire' as layer,
    1704067200 + (event_id % 28) * 86400 + (event_id % 24) * 3600 + (event_id % 60) * 60 as t, lat, lon, 300 + (event_id % 100)::double as brightness, case when event_id % 9 = 0 then null else (event_id % 50)::double / 4 end as frp
    from (select *, {_LAT} as lat, {_LON} as lon from events) where lat between -90 and 90""")
def fires(spark, sf):
    rows = _positions(spark, sf).selectExpr("concat_ws(',', lat, lon, 300 + event_id % 100, concat('2024-01-', lpad(1 + event_id % 28, 2, '0')), (event_id % 24) * 100 + event_id % 60, 'VIIRS', if(event_id % 9 = 0, 'nan', cast(cast(event_id % 50 as double) / 4 as string))) as raw")
    return f.fires(rows)[0].select("key", "layer", "t", "lat", "lon", "brightness", "frp")


@query("a6_vessels", f"""select 'ais:' || (200000000 + user_id) as key, 'maritime' as layer, lat, lon, 'SHIP ' || user_id as name,
    case when event_id % 4 > 0 then ((event_id * 37) % 360)::double when event_id % 6 > 0 then ((event_id * 7) % 360)::double + 0.5 end as heading, case when event_id % 10 = 0 then null else (event_id % 300)::double / 10 end as speed
    from (select *, {_LAT} as lat, {_LON} as lon from events) where event_id % 12 > 0 and abs(lat) <= 89.9""")
def vessels(spark, sf):
    return f.vessels(reports_of(_positions(spark, sf)))[0]


def reports_of(p):
    """Position reports as JSON lines."""
    report = F.struct(
        F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.expr("if(event_id % 6 = 0, 360D, cast((event_id * 7) % 360 as double) + 0.5D)").alias("Cog"),
        F.expr("if(event_id % 10 = 0, 102.3D, cast(event_id % 300 as double) / 10)").alias("Sog"), F.expr("if(event_id % 4 = 0, 511, cast((event_id * 37) % 360 as int))").alias("TrueHeading"),
    )
    message = F.struct(
        F.when(F.col("event_id") % 12 > 0, "PositionReport").otherwise("SafetyBroadcast").alias("MessageType"),
        F.struct((F.col("user_id") + 200_000_000).alias("MMSI"), F.concat(F.lit("SHIP "), "user_id", F.lit("@@@ ")).alias("ShipName")).alias("MetaData"), F.struct(report.alias("PositionReport")).alias("Message"),
    )
    return p.select(F.to_json(message).alias("raw"))


@query("a7_aircraft", f"""select 'aviation:' || printf('%06x', 4194304 + user_id) as key, 'aviation' as layer, epoch_us(ts) // 1000000 - event_id % 20 as t, lat, lon, case when event_id % 8 > 0 then round((event_id % 40000)::double * 0.3048::double, 1) end as alt,
    case when event_id % 3 > 0 then 'FL' || user_id end as name, event_id % 8 = 0 as on_ground, event_id % 100 = 7 as emergency from (select *, {_LAT} as lat, {_LON} as lon from events) where lat between -90 and 90 and event_id % 15 > 0""")
def aircraft(spark, sf):
    p = _positions(spark, sf).withColumn("batch", F.expr("t div 3600"))
    one = F.struct(
        F.format_string("%06x", F.col("user_id") + 4_194_304).alias("hex"), F.expr("if(event_id % 3 = 0, '        ', rpad(concat('FL', user_id), 8, ' '))").alias("flight"), "lat", "lon",
        F.expr("if(event_id % 8 = 0, 'ground', cast(event_id % 40000 as string))").alias("alt_baro"), F.lit(100.0).alias("gs"), F.expr("cast(event_id % 20 as double)").alias("seen_pos"),
        F.expr("if(event_id % 15 = 0, 'C1', 'A1')").alias("category"), F.expr("if(event_id % 100 = 7, '7700', '1000')").alias("squawk"),
    )
    lines = p.groupBy("t").agg(F.collect_list(one).alias("aircraft")).select(F.to_json(F.struct(F.col("t").cast("double").alias("now"), "aircraft")).alias("raw"))
    return f.aircraft(lines)[0]


@query("a11_a13_indicator_lines", """with l as (select c_custkey, case c_custkey % 7 when 0 then '# comment ' || c_custkey when 1 then '0.0.0.0 Ads' || c_custkey || '.Example.com # note' when 2 then 'https://Evil.example/' || c_custkey when 3 then '10.' || c_custkey % 250 || '.0.0/16' when 4 then '10.1.2.' || c_custkey % 250
    when 5 then upper(md5(c_custkey::varchar)) else '127.0.0.1 localhost' end as raw from customer)
    select raw, kind, case when kind = 'url' then token else lower(token) end as key from (select raw, case c_custkey % 7 when 1 then 'Ads' || c_custkey || '.Example.com' else raw end as token,
    case c_custkey % 7 when 1 then 'host' when 2 then 'url' when 3 then 'network' when 4 then 'ip' else 'hash' end as kind from l where c_custkey % 7 not in (0, 6))""")
def lines(spark, sf):
    raw = b.load(spark, sf, "customer").selectExpr("""case c_custkey % 7 when 0 then concat('# comment ', c_custkey) when 1 then concat('0.0.0.0 Ads', c_custkey, '.Example.com # note') when 2 then concat('https://Evil.example/', c_custkey) when 3 then concat('10.', c_custkey % 250, '.0.0/16')
        when 4 then concat('10.1.2.', c_custkey % 250) when 5 then upper(md5(cast(c_custkey as string))) else '127.0.0.1 localhost' end as raw""")
    return f.indicator_lines(raw).select("raw", "kind", "key")


@query("a28_mixed_times", """select event_id, case when event_id % 6 = 5 then null when event_id % 6 in (3, 4) then (epoch_us(ts) // 86400000000) * 86400 else epoch_us(ts) // 1000000 end as t from events""")
def times(spark, sf):
    e = b.load(spark, sf, "events").selectExpr("event_id", """case event_id % 6 when 0 then cast(unix_seconds(cast(ts as timestamp)) as string) when 1 then cast(unix_millis(cast(ts as timestamp)) as string) when 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        when 3 then date_format(ts, 'yyyyMMdd') when 4 then date_format(ts, 'dd/MM/yyyy') else 'yesterday' end as raw""")
    return e.select("event_id", f.mixed_time(F.col("raw")).alias("t"))


@query("a24_journal_lines", """select kind, count(*) as events, sum(case when event_id % 19 = 0 then 1 else 0 end)::bigint as corrupt from (select event_id, case when event_id % 19 = 0 then null else event_type end as kind from events) group by kind""")
def journal(spark, sf):
    e = b.load(spark, sf, "events").select(F.expr("if(event_id % 19 = 0, concat('{\"kind\": \"', event_type), to_json(struct(event_type as kind, event_id as seq)))").alias("raw"))
    parsed = e.select(F.from_json("raw", "kind string, seq bigint, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("j")).select("j.*")
    kind = F.when(F.col("seq").isNotNull(), F.col("kind"))
    return parsed.groupBy(kind.alias("kind")).agg(F.count("*").alias("events"), F.sum(F.when(F.col("seq").isNull(), 1).otherwise(0)).alias("corrupt"))


@query("a25_missed_slots", sql("""select module, slot from (select module, unnest(list_slice(range((last_t // 900 + 1) * 900, 1706745600 + 1, 900), 1, 8)) as slot from (select module, max(t) as last_t from journal where kind = 'poll.ok' group by module)) where slot <= 1706745600""", "journal"))
def slots(spark, sf):
    last = b.journal(spark, sf).where("kind = 'poll.ok'").groupBy("module").agg(F.max("t").alias("last_t"))
    return f.missed_slots(last, 1_706_745_600)


@query("a26_watermark", sql("select module, max(t) as last_ok from journal where kind = 'poll.ok' group by module", "journal"))
def watermark(spark, sf):
    return b.journal(spark, sf).where("kind = 'poll.ok'").groupBy("module").agg(F.max("t").alias("last_ok"))
