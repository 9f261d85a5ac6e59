"""Queries of folds, dimensions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import generators as g, merges as m
from ..sources import bindings as b
from .registry import query, sql

_FLAGGED = "flagged as (select *, ['adsb', 'mlat', 'tisb', 'other'][(seq % 4)::int + 1] as source, (1 << (seq % 5)::int)::bigint as flags from fixes)"


def flagged(spark, sf):
    return b.fixes(spark, sf).selectExpr("*", "element_at(array('adsb', 'mlat', 'tisb', 'other'), cast(seq % 4 as int) + 1) as source", "shiftleft(1L, cast(seq % 5 as int)) as flags")


@query("f3_aircraft_merge", sql("""with r as (select *, seq % 4 as rank, (1 << (seq % 5)::int)::bigint as flags, row_number() over (partition by id order by seq) as n from fixes),
    w as (select id, n, seq, t, rank, lat, lon, name, flags from r where n = 1 union all
    select r.id, r.n, case when k then r.seq else w.seq end, case when k then r.t else w.t end, case when k then r.rank else w.rank end, case when k then r.lat else w.lat end, case when k then r.lon else w.lon end,
    case when k then coalesce(r.name, w.name) else coalesce(w.name, r.name) end, w.flags | r.flags from w join r on r.id = w.id and r.n = w.n + 1, lateral (select r.t > w.t + 1 or (abs(r.t - w.t) <= 1 and r.rank < w.rank) as k))
    select id, seq, t, lat, lon, name, flags from w qualify row_number() over (partition by id order by n desc) = 1""", "fixes").replace("with ", "with recursive ", 1))
def whole_tracks(spark, sf):
    return m.merged_tracks(flagged(spark, sf))


@query("e24_known_flags", sql(f"with {_FLAGGED} select id, seq, flags, bit_or(flags) over (partition by id) as all_flags from flagged", "fixes"))
def flags(spark, sf):
    return m.known_flags(flagged(spark, sf)).select("id", "seq", "flags", "all_flags")


@query("k13_tile_hysteresis", sql("""with r as (select floor((lon + 180) / 30)::bigint as tile, t // 86400 as d, count(*) as n from fixes group by 1, 2), s as (select tile, d, n * 13 % 17 as n, row_number() over (partition by tile order by d) as k from r),
    w as (select tile, 0::bigint as k, 0 as tier, 0 as low from s where k = 1 union all
    select s.tile, s.k, case when want > w.tier then want when l >= 2 then want else w.tier end, case when l >= 2 then 0 else l end from w join s on s.tile = w.tile and s.k = w.k + 1,
    lateral (select case when s.n >= 10 or (w.tier = 2 and s.n >= 7) then 2 when s.n >= 1 then 1 else 0 end as want) x, lateral (select case when want < w.tier then w.low + 1 else 0 end as l) y)
    select tile, tier, k::int as readings from w qualify row_number() over (partition by tile order by k desc) = 1""", "fixes").replace("with ", "with recursive ", 1))
def hysteresis(spark, sf):
    r = b.fixes(spark, sf).groupBy(F.expr("cast(floor((lon + 180) / 30) as bigint)").alias("tile"), F.expr("t div 86400").alias("at")).agg(F.expr("count(*) * 13 % 17").alias("n"))
    return m.tiers(r)


@query("j5_j6_ecef_round_trip", sql("select seq, round(lat, 6) as lat, round(lon, 6) as lon, round(coalesce(alt, 0), 3) as alt from fixes", "fixes"))
def round_trip(spark, sf):
    x, y, z = geo.ecef("lat", "lon", "alt")
    back = m.geodetic("x", "y", "z")
    rows = b.fixes(spark, sf).select("seq", x.alias("x"), y.alias("y"), z.alias("z"))
    return rows.select("seq", *[(F.round(v, p) + 0.0).alias(n) for v, p, n in zip(back, (6, 6, 3), ("lat", "lon", "alt"), strict=True)])


@query("j12_coordinate_text", sql("""select seq, case when seq % 3 = 0 then null else round(abs(lat), 2) * case when seq % 3 = 1 then 1 else -1 end end as lat, case when seq % 3 = 0 then null else round(abs(lon), 2) * case when seq % 3 = 1 then 1 else -1 end end as lon from fixes""", "fixes"))
def coordinates(spark, sf):
    rows = b.fixes(spark, sf).selectExpr("seq", "case seq % 3 when 0 then '95.5, 10' when 1 then concat(abs(lat), ', ', abs(lon)) else concat(abs(lat), 'S ', abs(lon), 'W') end as q")
    lat, lon = m.parsed_position(F.col("q"))
    return rows.select("seq", (F.round(lat, 2) + 0.0).alias("lat"), (F.round(lon, 2) + 0.0).alias("lon"))


@query("j8_j13_precision", sql("""select target, vendor, precision, case precision when 'street' then 2 when 'city' then 3 when 'region' then 4 else 5 end::int as rank, case precision when 'street' then 150 when 'city' then 15000 when 'region' then 150000 else 600000 end::double as radius_m,
    precision = 'street' as pin from (select *, case when radius_km <= 0.15 then 'street' when radius_km <= 15 then 'city' when radius_km <= 150 then 'region' else 'country' end as precision from claims)""", "claims"))
def precision(spark, sf):
    return m.with_precision(b.claims(spark, sf).select("target", "vendor", m.radius_precision(F.col("radius_km")).alias("precision")))


@query("e23_country_names", "select c_custkey as target, n_name as country, r_name as region from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def countries(spark, sf):
    c, n, r = (b.load(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").selectExpr("c_custkey as target", "n_name as country", "r_name as region")


_MODULES = """modules as (select p_partkey as module, p_size as priority, case p_partkey % 5 when 0 then 'retired' when 1 then 'planned' else 'implemented' end as status, 'phase' || (p_partkey % 4) as phase,
    [['ip', 'domain', 'email', 'person'][(p_partkey % 4)::int + 1], ['ip', 'domain', 'email', 'person'][((p_partkey // 4) % 3)::int + 1]] as consumes from part)"""


def modules(spark, sf):
    kinds = "array('ip', 'domain', 'email', 'person')"
    return b.load(spark, sf, "part").selectExpr(
        "p_partkey as module", "p_size as priority", "case p_partkey % 5 when 0 then 'retired' when 1 then 'planned' else 'implemented' end as status", "concat('phase', p_partkey % 4) as phase",
        f"array(element_at({kinds}, cast(p_partkey % 4 as int) + 1), element_at({kinds}, cast((p_partkey div 4) % 3 as int) + 1)) as consumes",
    )


@query("e14_modules_for_type", f"""with {_MODULES}, a as (select module, priority, unnest(consumes) as type from modules where status <> 'retired')
    select type, module, place from (select type, module, row_number() over (partition by type order by priority desc, module)::int as place from a) where place <= 8 order by type, place""".replace("unnest(consumes)", "unnest(list_distinct(consumes))"))
def accepting(spark, sf):
    kinds = spark.createDataFrame([(k,) for k in ("ip", "domain", "email", "person")], "type string")
    return m.consumers(kinds, modules(spark, sf).withColumn("consumes", F.array_distinct("consumes")), 8)


@query("f11_catalog_coverage", f"with {_MODULES} select phase, status, count(*) as modules from modules group by rollup (phase, status)")
def coverage(spark, sf):
    return m.coverage(modules(spark, sf))


@query("c27_catalog_filter", f"with {_MODULES} select module, phase, status from modules where status = 'implemented' and list_contains(consumes, 'email') and phase in ('phase1', 'phase2')")
def filtered(spark, sf):
    return modules(spark, sf).where((F.col("status") == "implemented") & F.array_contains("consumes", "email") & F.col("phase").isin("phase1", "phase2")).select("module", "phase", "status")


@query("n5_catalog_errors", f"with {_MODULES} select module, status, c_custkey is null as dangling from modules left join customer on c_custkey = module * 2 where c_custkey is null and status <> 'retired'")
def dangling(spark, sf):
    known = b.load(spark, sf, "customer").selectExpr("c_custkey div 2 as module").where("c_custkey % 2 = 0").distinct()
    return modules(spark, sf).where("status <> 'retired'").join(known, "module", "left_anti").select("module", "status", F.lit(True).alias("dangling"))


@query("h8_containment_sweep", """with s as (select distinct user_id as key, (event_id * 31) % 5000 as lo, (event_id * 31) % 5000 + 10 + event_id % 400 as hi from events)
    select key, lo, hi from (select *, max(hi) over (partition by key order by lo, hi desc rows between unbounded preceding and 1 preceding) as m from s) where m is null or hi > m""")
def sweep(spark, sf):
    return m.outermost(b.load(spark, sf, "events").selectExpr("user_id as key", "(event_id * 31) % 5000 as lo", "(event_id * 31) % 5000 + 10 + event_id % 400 as hi"))


@query("h2_first_mention", sql("select type, value, seq, run from (select *, row_number() over (partition by type, value order by seq) as r from emissions) where r = 1", "emissions"))
def first(spark, sf):
    return b.emissions(spark, sf).groupBy("type", "value").agg(F.min_by(F.struct("seq", "run"), "seq").alias("f")).select("type", "value", "f.seq", "f.run")


@query("i1_i2_newest_first", sql("select seq, key, t, true as more from geo_events order by t desc, seq desc limit 100", "geo_events"))
def newest(spark, sf):
    return m.truncated(b.geo_events(spark, sf).select("seq", "key", "t"), [F.col("t").desc(), F.col("seq").desc()], 100)


@query("i3_ranked_entities", sql("select value, type, max(confidence) as score, count(*) as degree, max(t) as last_seen from emissions group by value, type order by score desc, degree desc, last_seen desc, value, type limit 200", "emissions"))
def ranked(spark, sf):
    rows = b.emissions(spark, sf).groupBy("value", "type").agg(F.max("confidence").alias("score"), F.count("*").alias("degree"), F.max("t").alias("last_seen"))
    return rows.orderBy(F.desc("score"), F.desc("degree"), F.desc("last_seen"), "value", "type").limit(200)


@query("i5_range_union", sql("select provider, prefix_len, lo, hi, region from networks union all select provider, prefix_len, lo, hi, null from blocks", "networks", "blocks"))
def union(spark, sf):
    return b.networks(spark, sf).unionByName(b.blocks(spark, sf), allowMissingColumns=True)


@query("i6_common_hosts", sql("select host from page_hosts where page_id % 2 = 0 intersect select host from page_hosts where page_id % 2 = 1", "page_hosts"))
def common(spark, sf):
    h = b.page_hosts(spark, sf)
    return h.where("page_id % 2 = 0").select("host").intersect(h.where("page_id % 2 = 1").select("host"))


@query("i7_own_keys_left_out", sql("select key, t from geo_events where seq % 2 = 0 except all select key, t from geo_events where seq % 6 = 0", "geo_events"))
def left_out(spark, sf):
    e = b.geo_events(spark, sf)
    return e.where("seq % 2 = 0").select("key", "t").exceptAll(e.where("seq % 6 = 0").select("key", "t"))


@query("f15_log_groups", sql("select module, rows % 7 as level, count(*) + sum(rows)::bigint as lines, min(t) as first_t, max(t) as last_t from journal where kind = 'log' group by 1, 2", "journal"))
def logs(spark, sf):
    j = b.journal(spark, sf).where("kind = 'log'").withColumn("level", F.expr("rows % 7"))
    both = j.select("module", "level", F.lit(1).cast("long").alias("n"), "t").union(j.select("module", "level", "rows", "t"))
    return both.groupBy("module", "level").agg(F.sum("n").alias("lines"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("k7_static_upsert", sql("""select value as key, type as layer, arg_max(lat, seq) filter (lat is not null) as lat, arg_max(lon, seq) filter (lon is not null) as lon, max(t) as updated_at, string_agg(distinct meta_key, ',' order by meta_key) as props from emissions group by value, type""", "emissions"))
def static(spark, sf):
    e = b.emissions(spark, sf)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return e.groupBy(F.col("value").alias("key"), F.col("type").alias("layer")).agg(known("lat"), known("lon"), F.max("t").alias("updated_at"), F.array_join(F.array_sort(F.collect_set("meta_key")), ",").alias("props"))


@query("k9_observation_store", sql("""select run, type, value, seq, left(repeat(meta_key || ' ', 200), 500) as excerpt, len(repeat(meta_key || ' ', 200))::int as size from emissions""", "emissions"))
def observations(spark, sf):
    raw = F.repeat(F.concat("meta_key", F.lit(" ")), 200)
    return b.emissions(spark, sf).select("run", "type", "value", "seq", F.substring(raw, 1, 500).alias("excerpt"), F.length(raw).alias("size"))


@query("b1_row_sanitising", """select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 then null else value end as value, replace(props, '"', '') as props from events""")
def sanitised(spark, sf):
    e = b.load(spark, sf, "events").selectExpr("event_id", "case when event_id % 7 = 0 then double('NaN') when event_id % 11 = 0 then double('Infinity') else value end as value", "concat(replace(props, '\"', ''), '\\u0000') as props")
    ok = ~F.isnan("value") & (F.abs("value") != float("inf"))
    return e.select("event_id", F.when(ok, F.col("value")).alias("value"), F.translate("props", "\x00", "").alias("props"))


@query("b2_routing", sql("select case when type = 'person' then 'entity' when lat is null then 'static' when type = 'ip' then 'track' else 'event' end as sink, count(*) as rows, max(seq) as last_seq from emissions group by 1", "emissions"))
def routing(spark, sf):
    sink = F.when(F.col("type") == "person", "entity").when(F.col("lat").isNull(), "static").when(F.col("type") == "ip", "track").otherwise("event")
    return b.emissions(spark, sf).groupBy(sink.alias("sink")).agg(F.count("*").alias("rows"), F.max("seq").alias("last_seq"))


@query("b3_geojson_export", sql("""select seq, '{"type":"Feature","id":"' || id || '","geometry":{"type":"Point","coordinates":[' || seq % 180 || ',' || seq % 90 || ']},"properties":{"t":' || t || '}}' as feature from fixes""", "fixes"))
def geojson(spark, sf):
    point = F.struct(F.lit("Point").alias("type"), F.array(F.expr("seq % 180"), F.expr("seq % 90")).alias("coordinates"))
    return b.fixes(spark, sf).select("seq", F.to_json(F.struct(F.lit("Feature").alias("type"), "id", point.alias("geometry"), F.struct("t").alias("properties"))).alias("feature"))


_GRID = """select band::int as band, band * (180::double / 29) - 90 as south, min(c)::int as columns from (select unnest(range(29)) as band), (select unnest(range(1, 361)) as c) where
    greatest(2 * 6371008.8::double * asin(sqrt(least(1::double, pow(sin((radians(band * (180::double / 29) - 90) - radians((band + 0.5) * (180::double / 29) - 90)) / 2), 2) + cos(radians((band + 0.5) * (180::double / 29) - 90)) * cos(radians(band * (180::double / 29) - 90)) * pow(sin(radians(180::double / c) / 2), 2)))),
    2 * 6371008.8::double * asin(sqrt(least(1::double, pow(sin((radians((band + 1) * (180::double / 29) - 90) - radians((band + 0.5) * (180::double / 29) - 90)) / 2), 2) + cos(radians((band + 0.5) * (180::double / 29) - 90)) * cos(radians((band + 1) * (180::double / 29) - 90)) * pow(sin(radians(180::double / c) / 2), 2))))) <= 463000 * 0.97 group by band"""


@query("g11_coverage_grid", sql(f"""with rows as ({_GRID}) select band, columns, least(columns - 1, floor((lon + 180) / 360 * columns))::int as col, count(*) as features
    from (select *, least(28, floor((lat + 90) / (180::double / 29)))::int as band from fixes) join rows using (band) group by all""", "fixes"))
def grid(spark, sf):
    band = F.least(F.lit(28), F.floor((F.col("lat") + 90) / (180.0 / 29))).cast("int")
    col = F.least(F.col("columns") - 1, F.floor((F.col("lon") + 180) / 360 * F.col("columns"))).cast("int")
    placed = b.fixes(spark, sf).withColumn("band", band).join(F.broadcast(g.coverage_rows(spark)), "band")  # 29 rows
    return placed.groupBy("band", "columns", col.alias("col")).agg(F.count("*").alias("features"))


@query("f19_band_density", sql("select least(28, floor((lat + 90) / (180::double / 29)))::int as band, count(*) as fixes, count(distinct id) as tracks from fixes group by 1", "fixes"))
def bands(spark, sf):
    band = F.least(F.lit(28), F.floor((F.col("lat") + 90) / (180.0 / 29))).cast("int")
    return b.fixes(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("fixes"), F.countDistinct("id").alias("tracks"))


@query("c23_squawk_flags", "select event_id, event_id % 40 in (0, 1, 2) as emergency, (event_id * 13) % 300 > 60 as stale from events")
def squawks(spark, sf):
    e = b.load(spark, sf, "events").selectExpr("event_id", "case event_id % 40 when 0 then '7500' when 1 then '7600' when 2 then '7700' else '1200' end as squawk", "(event_id * 13) % 300 as age")
    return e.select("event_id", F.col("squawk").isin("7500", "7600", "7700").alias("emergency"), (F.col("age") > 60).alias("stale"))


@query("c24_privacy_exclusion", sql("select seq, id from fixes where seq % 16 & 12 = 0 and cast(split_part(id, ':', 2) as bigint) % 10 > 0", "fixes"))
def privacy(spark, sf):
    f = b.fixes(spark, sf)
    listed = f.where("cast(substring_index(id, ':', -1) as bigint) % 10 = 0").select("id").distinct()
    return f.where(F.expr("seq % 16").bitwiseAND(12) == 0).join(listed, "id", "left_anti").select("seq", "id")
