"""Queries of the matching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import matching as m
from ..sources import bindings as b
from .registry import query, sql


@query("e1_indicator_exact", sql("""
    select target, kind, key, list, 0.95::double as confidence from (select page_id as target, 'host' as kind, host as key from page_hosts
    union all select page_id, 'url', url from page_hosts union all select target, 'ip', ip from addresses) join indicators using (kind, key)""", "page_hosts", "indicators", "addresses"))
def exact(spark, sf):
    pages = b.page_hosts(spark, sf)
    targets = pages.selectExpr("page_id as target", "'host' as kind", "host as key").union(pages.selectExpr("page_id", "'url'", "url")).union(b.addresses(spark, sf).selectExpr("target", "'ip'", "ip"))
    return m.exact_matches(targets, b.indicators(spark, sf))


@query("e2_ip_in_network", sql("select target, ip, provider, prefix_len, 0.8::double as confidence from addresses join networks on ip_num between lo and hi", "addresses", "networks"))
def in_network(spark, sf):
    return m.in_networks(b.addresses(spark, sf), b.networks(spark, sf)).select("target", "ip", "provider", "prefix_len", F.lit(0.8).alias("confidence"))


@query("e3_netblock_overlap", sql("""
    select a.provider as a_provider, a.prefix_len as a_prefix_len, a.lo as a_lo, a.hi as a_hi, n.provider as b_provider, n.prefix_len as b_prefix_len, n.lo as b_lo, n.hi as b_hi
    from blocks a join networks n on a.lo <= n.hi and n.lo <= a.hi""", "networks", "blocks"))
def overlap(spark, sf):
    return m.overlapping(b.blocks(spark, sf), b.networks(spark, sf))


@query("e3_network_members", sql("""
    select provider, target, ip, place from (select provider, target, ip, row_number() over (partition by provider order by ip_num, target)::int as place
    from addresses join networks on ip_num between lo and hi) where place <= 50""", "addresses", "networks"))
def members(spark, sf):
    return m.first_members(b.addresses(spark, sf), b.networks(spark, sf))


_SUFFIXES = """suffixes as (select *, array_to_string(list_slice(l, i + 1, len(l)), '.') as suffix, i as depth from
    (select *, string_split(host, '.') as l from {t}) x, lateral (select unnest(range(len(l))) as i))"""


@query("e4_parent_host", sql(f"""with deep as (select page_id as target, 'a' || page_id || '.' || host as host from page_hosts), listed as (select distinct key from indicators where kind = 'host'),
    {_SUFFIXES.format(t='deep')}
    select target, host, arg_min(suffix, depth) as parent, 0.6::double as confidence from suffixes join listed on key = suffix where depth > 0 and contains(suffix, '.') group by all""", "page_hosts", "indicators"))
def parent(spark, sf):
    targets = b.page_hosts(spark, sf).selectExpr("page_id as target", "concat('a', page_id, '.', host) as host")
    return m.parent_matches(targets, b.indicators(spark, sf).where("kind = 'host'"))


@query("e5_subdomain_members", sql(f"""with h as (select distinct host from page_hosts), d as (select distinct array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain from page_hosts),
    {_SUFFIXES.format(t='h')}
    select domain, host, place, 0.85::double as confidence from (select domain, host, row_number() over (partition by domain order by host)::int as place
    from suffixes join d on suffix = domain where depth > 0) where place <= 50""", "page_hosts"))
def subdomains(spark, sf):
    hosts = b.page_hosts(spark, sf)
    return m.subdomain_members(hosts.select(F.substring_index("host", ".", -2).alias("domain")), hosts.select(F.col("host").alias("key")))


@query("e6_url_prefix", sql("""with targets as (select page_id as target, case when page_id % 2 = 0 then url || '/more' else regexp_replace(url, '/[^/]*$', '') end as url from page_hosts),
    listed as (select distinct key, regexp_replace(key, '/+$', '') as k from indicators where kind = 'url'),
    t as (select target, url, regexp_replace(url, '/+$', '') as u from targets where url not in (select key from listed))
    select target, url, arg_max(key, (length(key), -rank)) as listed, 0.9::double as confidence from (select target, url, key, row_number() over (partition by target order by key) as rank
    from t join listed on u = k or starts_with(u, k || '/') or starts_with(k, u || '/')) group by target, url""", "page_hosts", "indicators"))
def url_prefix(spark, sf):
    targets = b.page_hosts(spark, sf).selectExpr("page_id as target", "if(page_id % 2 = 0, concat(url, '/more'), regexp_replace(url, '/[^/]*$', '')) as url")
    return m.url_prefix_matches(targets, b.indicators(spark, sf).where("kind = 'url'"))


@query("e7_scope", sql("""select page_id, host from page_hosts p where exists (select 1 from page_hosts s where s.page_id % 25 = 0 and (p.host = s.host or ends_with(p.host, '.' || s.host)))""", "page_hosts"))
def scope(spark, sf):
    hosts = b.page_hosts(spark, sf).select("page_id", "host")
    return m.in_scope(hosts, hosts.where("page_id % 25 = 0").select(F.col("host").alias("scope")))


@query("e8_public_suffix", sql("""with h as (select page_id, case page_id % 3 when 0 then host || '.co.uk' when 1 then host else 'single' end as host from page_hosts),
    s as (select page_id, host, string_split(host, '.') as l, case when len(string_split(host, '.')) > 1 and array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') in ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br') then 2 else 1 end as k from h)
    select page_id, host, array_to_string(list_slice(l, -k, -1), '.') as suffix, case when len(l) > k then array_to_string(list_slice(l, -k - 1, -1), '.') end as registrable from s""", "page_hosts"))
def suffix(spark, sf):
    hosts = b.page_hosts(spark, sf).selectExpr("page_id", "case page_id % 3 when 0 then concat(host, '.co.uk') when 1 then host else 'single' end as host")
    return m.registrable(hosts)


@query("e9_longest_prefix", sql("""select target, ip, provider, prefix_len, region from (select *, row_number() over (partition by target order by prefix_len desc, provider) as r
    from addresses join networks on ip_num between lo and hi) where r = 1""", "addresses", "networks"))
def longest(spark, sf):
    return m.longest_prefix(b.addresses(spark, sf), b.networks(spark, sf))


@query("e10_hosting_range", sql("""select target, ip, provider, prefix_len, n_name as region_name, row_number() over (partition by target order by prefix_len desc, provider)::int as place
    from addresses join networks on ip_num between lo and hi left join nation on region = n_nationkey""", "addresses", "networks"))
def hosting(spark, sf):
    found = m.in_networks(b.addresses(spark, sf), b.networks(spark, sf)).join(b.load(spark, sf, "nation"), F.col("region") == F.col("n_nationkey"), "left")
    return found.selectExpr("target", "ip", "provider", "prefix_len", "n_name as region_name", "row_number() over (partition by target order by prefix_len desc, provider) as place")


@query("e16_radius_join", sql("""with c as (select s_suppkey as cid, cast((s_suppkey * 7919) % 17000 as double) / 100::double - 85::double as clat, cast((s_suppkey * 104729) % 36000 as double) / 100::double - 180::double as clon from supplier)
    select cid, seq as pid, round(d, 3) as metres from (select cid, seq, 2 * 6371008.8::double * asin(sqrt(least(1::double, pow(sin((radians(lat) - radians(clat)) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(clon)) / 2), 2)))) as d
    from c, fixes where abs(lat - clat) < 3) where d <= 150000""", "fixes"))
def radius(spark, sf):
    centres = b.load(spark, sf, "supplier").selectExpr("s_suppkey as cid", "cast((s_suppkey * 7919) % 17000 as double) / 100D - 85D as clat", "cast((s_suppkey * 104729) % 36000 as double) / 100D - 180D as clon")
    points = b.fixes(spark, sf).selectExpr("seq as pid", "lat", "lon")
    return m.radius_pairs(centres, points, 150_000.0).select("cid", "pid", F.round("d", 3).alias("metres"))


@query("e17_bounding_box", sql("select seq, id, lat, lon from fixes where lat between -30 and 40 and (lon >= 150 or lon <= -160)", "fixes"))
def box(spark, sf):
    return b.fixes(spark, sf).where(geo.in_box("lat", "lon", -30.0, 150.0, 40.0, -160.0)).select("seq", "id", "lat", "lon")


@query("c6_public_address", sql(f"""select target, ip, not ({' or '.join(f'ip_num between {m.number(i)} and {m.number(i) + 2 ** (32 - p) - 1}' for i, p in m.SPECIAL_RANGES)}) as public from addresses""", "addresses"))
def public(spark, sf):
    return b.addresses(spark, sf).select("target", "ip", m.is_public().alias("public"))


@query("g6_neighbour_addresses", sql("""select target, ip, near, row_number() over (partition by target order by abs(n - ip_num), n)::int as place from
    (select *, concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) as near from addresses, lateral (select unnest(range(ip_num - 4, ip_num + 5)) as n) x)
    where n <> ip_num and n > ip_num - ip_num % 256 and n < ip_num - ip_num % 256 + 255""", "addresses"))
def near(spark, sf):
    return m.neighbours(b.addresses(spark, sf))


@query("g7_cidr_expansion", sql("""select provider, prefix_len, ip_num, concat_ws('.', ip_num // 16777216, ip_num // 65536 % 256, ip_num // 256 % 256, ip_num % 256) as ip
    from networks, lateral (select unnest(range(lo + 1, least(hi - 1, lo + 256) + 1)) as ip_num) where prefix_len < 31""", "networks"))
def expansion(spark, sf):
    return m.expand(b.networks(spark, sf))


@query("g8_reverse_dns", sql("select target, ip, ip_num, array_to_string(list_reverse(string_split(ip, '.')), '.') || '.in-addr.arpa' as name from addresses", "addresses"))
def reverse(spark, sf):
    return m.reverse_labels(b.addresses(spark, sf))


@query("i4_address_order", sql("select target, ip, row_number() over (order by ip_num, target)::bigint as place from addresses", "addresses"))
def ordered(spark, sf):
    return m.address_order(b.addresses(spark, sf))


@query("j_geo_functions", sql("""select seq, round(degrees(asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(t))), 6) as dest_lat,
    round((6378137::double / sqrt(1 - e2 * pow(sin(a), 2)) + h) * cos(a) * cos(o), 2) as ecef_x, round((6378137::double / sqrt(1 - e2 * pow(sin(a), 2)) * (1 - e2) + h) * sin(a), 2) as ecef_z,
    greatest(0, least(1023, floor((lon + 180) / 360 * 1024)))::int as tile_x, round(h / 0.3048::double, 3) as feet from
    (select seq, lon, radians(lat) as a, radians(lon) as o, radians(coalesce(heading, 0)) as t, coalesce(speed, 0) * 1000 / 6371008.8::double as d, coalesce(alt, 0) as h,
    (1 / 298.257223563::double) * (2 - 1 / 298.257223563::double) as e2 from fixes)""", "fixes"))
def geo_functions(spark, sf):
    f = b.fixes(spark, sf)
    x, _, z = geo.ecef("lat", "lon", "alt")
    to, _ = geo.destination("lat", "lon", F.coalesce("heading", F.lit(0.0)), F.coalesce("speed", F.lit(0.0)) * 1000)
    tx, _ = geo.tile("lat", "lon", 10)
    return f.select("seq", F.round(to, 6).alias("dest_lat"), F.round(x, 2).alias("ecef_x"), F.round(z, 2).alias("ecef_z"), tx.alias("tile_x"), F.round(F.coalesce("alt", F.lit(0.0)) / geo.FEET_M, 3).alias("feet"))


@query("h10_track_kinematics", sql("""select id, seq, t, round(2 * 6371008.8::double * asin(sqrt(least(1::double, pow(sin((radians(lat) - radians(y)) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(x)) / 2), 2)))), 3) as metres,
    t > lt as moved from (select *, lag(lat) over w as y, lag(lon) over w as x, lag(t) over w as lt from fixes window w as (partition by id order by t, seq)) where lt is not null""", "fixes"))
def kinematics(spark, sf):
    return geo.kinematics(b.fixes(spark, sf)).select("id", "seq", "t", F.round("metres", 3).alias("metres"), F.col("speed_ms").isNotNull().alias("moved"))
