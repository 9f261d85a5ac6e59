"""Queries of aircraft arrays, layers, suggestions, layer deltas and plain text of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aircraft as a, checksums, merges as m, search as s, text as t
from ..sources import bindings as b
from .registry import query

_T = "unix_seconds(cast(ts as timestamp))"
_STATE = """concat('["', lower(lpad(hex(event_id), 6, 'a')), '", "CS', user_id, ' ", "Land", ', {t} - event_id % 90, ', 0, ', (event_id % 360) - 180, ', ', case when event_id % 13 = 0 then 'null' else cast((event_id % 170) - 85 as {s}) end, ', ', event_id % 9000, ', ', case when event_id % 4 = 0 then 'true' else 'false' end, ', ', event_id % 300, ', ', event_id % 360, ', ', event_id % 7, ', null, ', event_id % 9100, ', "7000", false, ', event_id % 6, ', ', event_id % 22, ']')"""
_SNAP = "concat('{{\"time\": ', {t}, ', \"states\": [', {x}, ', [\"short\"]]}}')"


@query("a8_aircraft_arrays", """select lower(lpad(to_hex(event_id), 6, 'a')) as hex, 'CS' || user_id as callsign, 'Land' as country, (epoch_us(ts) // 1000000 - event_id % 90)::double as t, ((event_id % 170) - 85)::double as lat, ((event_id % 360) - 180)::double as lon, event_id % 4 = 0 as on_ground, (event_id % 9100)::double as alt_geom_m, (event_id % 9000)::double as alt_baro_m,
    round((event_id % 300) * 1.943844::double, 3) as speed_kt, (event_id % 360)::double as track, round((event_id % 7) * 196.850394::double, 3) as climb_fpm, '7000' as squawk, coalesce(['adsb', 'asterix', 'mlat', 'flarm'][(event_id % 6)::int + 1], 'other') as source
    from events where event_id % 13 <> 0 and event_id % 90 <= 60 and event_id % 22 not between 16 and 20""")
def arrays(spark, sf):
    line = _SNAP.format(t=_T, x=_STATE.format(t=_T, s="string"))
    return a.states(b.load(spark, sf, "events").selectExpr(f"{line} as line"))


@query("a9_aircraft_tracks", """select 'aviation:' || case when event_id % 10 = 0 then '~' else '' end || lower(lpad(to_hex(event_id), 6, '0')) || case when event_id % 10 = 0 then '@feed' else '' end as key,
    case when event_id % 3 > 0 then 'CS' || user_id when event_id % 6 = 0 then 'R' || user_id else case when event_id % 10 = 0 then '~' else '' end || lower(lpad(to_hex(event_id), 6, '0')) end as name, epoch_us(ts) // 1000000 as t, 1.5::double as lat, 2.25::double as lon,
    case when event_id % 4 > 0 then case when event_id % 5 > 0 then (event_id % 900)::double when event_id % 7 > 0 then (event_id % 800)::double end end as alt, event_id % 16 % 2 = 1 as military, event_id % 16 // 2 % 2 = 1 as interesting, event_id % 16 // 4 % 2 = 1 as pia, event_id % 16 // 8 = 1 as ladd from events""")
def tracks(spark, sf):
    rows = b.load(spark, sf, "events").selectExpr(
        "concat(if(event_id % 10 = 0, '~', ''), lower(lpad(hex(event_id), 6, '0'))) as hex", "if(event_id % 3 > 0, concat('CS', user_id), null) as callsign", "if(event_id % 6 = 0, concat('R', user_id), null) as registration", f"{_T} as t", "1.5D as lat", "2.25D as lon",
        "event_id % 4 = 0 as on_ground", "if(event_id % 5 > 0, cast(event_id % 900 as double), null) as alt_geom_m", "if(event_id % 7 > 0, cast(event_id % 800 as double), null) as alt_baro_m", "cast(event_id % 16 as int) as flags",
    )
    return a.track_rows(rows, "feed")


@query("c7_page_text", r"""select page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) as text_sha256, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') as slug from pages""")
def page_text(spark, sf):
    return b.load(spark, sf, "pages").select("page_id", F.sha2(t.strip_tags(F.col("html")), 256).alias("text_sha256"), t.slug(F.col("url")).alias("slug"))


@query("e15_placed_layers", """select c_custkey as id, c_mktsegment as type, layer from customer join (select r_name as layer, unnest(types) as type from (select r_name, case r_regionkey % 3 when 0 then ['BUILDING', 'MACHINERY'] when 1 then ['AUTOMOBILE'] else ['HOUSEHOLD', 'BUILDING', 'FURNITURE'] end as types from region)) on type = c_mktsegment""")
def layers(spark, sf):
    dim = b.load(spark, sf, "region").selectExpr("r_name as layer", "case r_regionkey % 3 when 0 then array('BUILDING', 'MACHINERY') when 1 then array('AUTOMOBILE') else array('HOUSEHOLD', 'BUILDING', 'FURNITURE') end as types")
    return s.placed_layers(b.load(spark, sf, "customer").selectExpr("c_custkey as id", "c_mktsegment as type"), dim).select("id", "type", "layer")


@query("m10_suggestions", """with p as (select c_custkey as qid, ['vessel', 'ip', 'geo_point', null][(c_custkey % 4)::int + 1] as kind, c_name as value, (c_custkey % 10) / 10.0::double as confidence, c_custkey % 3 > 0 as pivots, c_custkey % 5 = 0 as found from customer),
    mods as (select s_name as module, ['vessel', 'ip', 'geo_point'][(s_suppkey % 3)::int + 1] as type, s_nationkey as priority from supplier)
    select qid, 0 as place, 'fly_to' as kind, case kind when 'geo_point' then 'Fly to ' || value else 'Track vessel ' || value end as label from p where kind in ('vessel', 'geo_point')
    union all select qid, 1, 'create_entity', 'Add ' || kind || ' ' || value || ' to the investigation' from p where kind is not null and confidence >= 0.6 and pivots and not found
    union all select qid, k + 1, 'run_module', 'Run ' || module from p join (select *, row_number() over (partition by type order by priority, module) as k from mods) on type = kind where k <= 8""")
def suggested(spark, sf):
    p = b.load(spark, sf, "customer").selectExpr("c_custkey as qid", "element_at(array('vessel', 'ip', 'geo_point', null), cast(c_custkey % 4 as int) + 1) as primary", "c_name as value", "(c_custkey % 10) / 10D as confidence", "c_custkey % 3 > 0 as pivots", "c_custkey % 5 = 0 as found")
    mods = b.load(spark, sf, "supplier").selectExpr("s_name as module", "element_at(array('vessel', 'ip', 'geo_point'), cast(s_suppkey % 3 as int) + 1) as type", "s_nationkey as priority")
    return s.suggestions(p, mods)


@query("b5_layer_deltas", """with f as (select event_id // 500 as batch, event_type as layer, 'f' || (user_id % 20) as id, event_id as seq, unnest(['value', 'name']) as k, unnest([case when event_id % 3 = 0 then null else event_id::varchar end, case when event_id % 4 = 0 then repeat('x', 600) else 'n' || user_id end]) as v from events),
    l as (select batch, layer, id, max_by(v, seq) filter (v is not null and len(v) <= 512 and k = 'value') as value, max_by(v, seq) filter (v is not null and len(v) <= 512 and k = 'name') as name from f group by all),
    j as (select batch, layer, id, '{' || concat_ws(',', '"name":"' || name || '"', '"value":"' || value || '"') || '}' as props from l)
    select batch, layer, count(*) as features, '[' || string_agg('{"id":"' || id || '","props":"' || replace(props, '"', '\\"') || '"}', ',' order by id) || ']' as message from j group by all""")
def deltas(spark, sf):
    writes = b.load(spark, sf, "events").selectExpr("event_id div 500 as batch", "event_type as layer", "concat('f', user_id % 20) as id", "event_id as seq", "map('value', if(event_id % 3 = 0, null, cast(event_id as string)), 'name', if(event_id % 4 = 0, repeat('x', 600), concat('n', user_id))) as props")
    return m.layer_deltas(writes)


_ADDRESSES = "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa 3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy".split()
_PICKED = f"element_at(array({', '.join(map(repr, _ADDRESSES))}), cast(c_custkey % 3 as int) + 1)"


@query("c3_coin_addresses", f"""with w as (select c_custkey as "user", [{', '.join(map(repr, _ADDRESSES))}][(c_custkey % 3)::int + 1] as word, (4 + c_custkey % 30)::int as spot from customer)
    select "user", case when "user" % 4 = 0 then word else substr(word, 1, spot - 1) || 'p' || substr(word, spot + 1) end as word, "user" % 4 = 0 or substr(word, spot, 1) = 'p' as valid from w""")
def coins(spark, sf):
    """Addresses of all customers, most of them with one character changed, and whether their checksum holds."""
    words = b.load(spark, sf, "customer").selectExpr("c_custkey as user", f"{_PICKED} as word", "cast(4 + c_custkey % 30 as int) as at")
    return words.selectExpr("user", "if(user % 4 = 0, word, concat(substr(word, 1, at - 1), 'p', substr(word, at + 1))) as word").withColumn("valid", checksums.coin_address("word"))
