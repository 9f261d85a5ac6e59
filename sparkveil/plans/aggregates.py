"""Queries of fusion, feed health and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..sources import bindings as b
from .registry import query, sql

_HAV = "2 * 6371008.8::double * asin(sqrt(least(1::double, pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin((radians({x2}) - radians({x1})) / 2), 2))))"


def _vote(field: str) -> str:
    return f"""{field}_v as (select target, case when w = lag(w, -1) over w and r = 1 then null else {field} end as {field}, n > 1 as {field}_conflict, r from
        (select *, count(*) over (partition by target) as n, row_number() over (partition by target order by w desc, {field} desc) as r from
        (select target, {field}, sum(case when age_days > 45 then 0.5 else 1 end)::double as w from claims where {field} is not null group by all))
        window w as (partition by target order by r) qualify r = 1)"""


@query("f1_evidence_vote", sql(f"with {_vote('country')} select target, country, country_conflict from country_v", "claims"))
def vote(spark, sf):
    return a.vote(b.claims(spark, sf), "country")


@query("f2_geoip_fusion", sql(f"""with {_vote('country')}, {_vote('asn')},
    best as (select * from claims qualify row_number() over (partition by target order by age_days > 45, radius_km, age_days, vendor) = 1),
    apart as (select c.target, max({_HAV.format(y1='c.lat', x1='c.lon', y2='z.lat', x2='z.lon')} / 1000) as km from claims c join best z on c.target = z.target group by c.target)
    select z.target, z.vendor, country_v.country, asn_v.asn, coalesce(country_conflict, false) as country_conflict, coalesce(asn_conflict, false) as asn_conflict, round(km, 3) as apart_km,
    case when greatest(radius_km, least(km, 600)) <= 15 then 'city' when greatest(radius_km, least(km, 600)) <= 150 then 'region' else 'country' end as precision,
    case when coalesce(country_conflict, false) then 0.7::double * 0.6::double else 0.7::double end as confidence
    from best z join apart p on z.target = p.target left join country_v on country_v.target = z.target left join asn_v on asn_v.target = z.target""", "claims"))
def fusion(spark, sf):
    return a.fuse(b.claims(spark, sf))


@query("f8_halo_grouping", sql("""select layer, precision, round(lat, 4) as lat, round(lon, 4) as lon, min(seq) as seq, case when count(*) > 1 then count(*) end as grouped from
    (select event_type as layer, case event_id % 2 when 0 then 'region' else 'country' end as precision, ((event_id * 7919) % 170)::double - 85 as lat, ((event_id * 104729) % 360)::double - 180 as lon, event_id as seq from events) group by 1, 2, 3, 4"""))
def halo(spark, sf):
    points = b.load(spark, sf, "events").selectExpr("event_type as layer", "if(event_id % 2 = 0, 'region', 'country') as precision", "cast((event_id * 7919) % 170 as double) - 85 as lat", "cast((event_id * 104729) % 360 as double) - 180 as lon", "event_id as seq")
    return a.halos(points)


@query("f9_layer_freshness", sql("select layer, count(*) as rows, max(t) as newest, count(*) filter (t between 1705000000 - 3600 and 1705000000) as last_hour from geo_events group by layer", "geo_events"))
def fresh(spark, sf):
    return a.freshness(b.geo_events(spark, sf), 1_705_000_000)


@query("f10_quality_checks", sql("""select type, count(*) as rows, count(*) filter (lat is null) as no_geo, count(*) filter (value is null) as no_key, count(*) filter (t is null) as no_time,
    count(*) filter (t > 900000000 + 3600) as future, count(*) filter (abs(lat) > 89.9) as bad_lat from emissions group by type""", "emissions"))
def quality(spark, sf):
    return a.quality_counts(b.emissions(spark, sf), 900_000_000)


@query("f12_metric_summary", sql("select module, min(value) as least, max(value) as most, arg_min(value, (t, seq)) as first, arg_max(value, (t, seq)) as last, round(avg(value), 6) as mean from journal where kind = 'metric' and value is not null group by module", "journal"))
def metrics(spark, sf):
    return a.metric_summary(b.journal(spark, sf))


_SEGMENTS = "seg as (select *, sum(case when seq % 400 = 0 then 1 else 0 end) over (partition by module order by t, seq rows unbounded preceding)::bigint as segment from journal)"


@query("h6_process_segments", sql(f"with {_SEGMENTS} select module, segment, count(*) as events, min(t) as opened, max(t) as closed from seg group by all", "journal"))
def segments(spark, sf):
    return a.segments(b.journal(spark, sf), "seq % 400 = 0").groupBy("module", "segment").agg(F.count("*").alias("events"), F.min("t").alias("opened"), F.max("t").alias("closed"))


@query("f13_linear_trend", sql(f"""with {_SEGMENTS}, z as (select *, min(t) over (partition by module, segment) as t0 from seg),
    fits as (select module, segment, regr_slope(value, (t - t0) / 3600::double) as slope, count(*) as points, max(t) - min(t) as span from z where t - t0 >= 900 and value is not null group by all having count(*) >= 3)
    select module, segment, round(slope, 6) as slope, points, span from fits qualify row_number() over (partition by module order by span desc, segment desc) = 1""", "journal"))
def trend(spark, sf):
    return a.trends(a.segments(b.journal(spark, sf), "seq % 400 = 0")).withColumn("slope", F.round("slope", 6))


@query("f14_error_groups", sql(r"""select module, regexp_replace(regexp_replace(regexp_replace(message, '0x[0-9a-f]+', '<hex>', 'g'), '\b\d+\.\d+\b', '<num>', 'g'), '\d+', '<n>', 'g') as message,
    count(*) as n, min(t) as first_t, max(t) as last_t from journal where kind = 'poll.error' group by 1, 2""", "journal"))
def errors(spark, sf):
    return a.error_groups(b.journal(spark, sf))


@query("f16_feed_scorecard", sql("""select module, ok, failed, stored, round(100::double * ok / (ok + failed), 2) as share, case when ok + failed = 0 then 'NOT DUE' when ok = 0 then 'FAIL' when round(100::double * ok / (ok + failed), 2) < 50 then 'WARN' else 'PASS' end as verdict
    from (select module, count(*) filter (kind = 'poll.ok') as ok, count(*) filter (kind = 'poll.error') as failed, sum(case when kind = 'sink.stats' then rows else 0 end)::bigint as stored from journal group by module)""", "journal"))
def card(spark, sf):
    return a.scorecard(b.journal(spark, sf))


@query("f18_row_deltas", sql("select module, arg_min(rows, (t, seq)) as first, arg_max(rows, (t, seq)) as last, arg_max(rows, (t, seq)) - arg_min(rows, (t, seq)) as delta from journal group by module", "journal"))
def row_deltas(spark, sf):
    return a.deltas(b.journal(spark, sf), "module", "rows")


@query("f19_tile_density", sql("""select g.y::int as y, g.x::int as x, coalesce(n, 0) as features, case when coalesce(n, 0) >= 10 then 'hot' when coalesce(n, 0) >= 1 then 'warm' else 'cold' end as tier
    from (select unnest(range(36)) as y) a, (select unnest(range(72)) as x) z, lateral (select a.y as y, z.x as x) g
    left join (select least(35, floor((lat + 90) / 5))::int as y, least(71, floor((lon + 180) / 5))::int as x, count(*) as n from fixes group by 1, 2) c on c.y = g.y and c.x = g.x""", "fixes"))
def density(spark, sf):
    return a.tile_density(b.fixes(spark, sf))


@query("f20_run_stats", sql("select run, type, count(*) as emitted, count(distinct value) as entities, count(*) filter (lat is not null) as placed from emissions group by all", "emissions"))
def run_stats(spark, sf):
    return b.emissions(spark, sf).groupBy("run", "type").agg(F.count("*").alias("emitted"), F.countDistinct("value").alias("entities"), F.count_if(F.col("lat").isNotNull()).alias("placed"))


@query("f21_distinct_infrastructure", sql("select array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, count(distinct host) as hosts, count(distinct url) as urls from page_hosts group by 1", "page_hosts"))
def infrastructure(spark, sf):
    return b.page_hosts(spark, sf).groupBy(F.substring_index("host", ".", -2).alias("domain")).agg(F.countDistinct("host").alias("hosts"), F.countDistinct("url").alias("urls"))


@query("f6_verdict_rollup", sql("""select target, max(confidence) as confidence, string_agg(distinct list, ',' order by list) as lists, count(*) as hits from
    (select target, list, 0.95::double as confidence from addresses join indicators on kind = 'ip' and key = ip union all select target, 'network ' || provider, 0.8::double from addresses join networks on ip_num between lo and hi) group by target""", "addresses", "indicators", "networks"))
def verdicts(spark, sf):
    from ..operators import matching as m

    ips = b.addresses(spark, sf)
    listed = m.exact_matches(ips.selectExpr("target", "'ip' as kind", "ip as key"), b.indicators(spark, sf)).select("target", "list", "confidence")
    nets = m.in_networks(ips, b.networks(spark, sf)).select("target", F.concat(F.lit("network "), "provider").alias("list"), F.lit(0.8).alias("confidence"))
    both = listed.union(nets).groupBy("target")
    return both.agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.count("*").alias("hits"))


@query("h4_longest_gap", sql("""select module, max(gap) as gap, arg_max(t, (gap, -t)) as until from (select module, t, t - lag(t) over (partition by module order by t, seq) as gap from
    (select module, t, seq from journal where kind = 'poll.ok' union all select distinct module, 1706745600, 4611686018427387904 from journal where kind = 'poll.ok')) where gap is not null group by module""", "journal"))
def gaps(spark, sf):
    return a.longest_gaps(b.journal(spark, sf), 1_706_745_600)


@query("h5_stalls", sql("""select module, seq, t, recovered from (select *, min(case when kind = 'poll.ok' then t end) over (partition by module order by t, seq rows between 1 following and unbounded following) as recovered from journal) where kind = 'poll.error'""", "journal"))
def stalls(spark, sf):
    return a.stalls(b.journal(spark, sf))


@query("h7_timeline", sql("""select seq, t, kind, module, message, rows, value from (select *, row_number() over (partition by module order by t, seq) as a, row_number() over (partition by module order by t desc, seq desc) as z from journal) where a <= 100 or z <= 200""", "journal"))
def timeline(spark, sf):
    return a.timeline(b.journal(spark, sf), 100, 200)


@query("l7_hourly_quota", sql("select module, kind, t // 3600 * 3600 as hour, count(*) as total, max(t) as last_t, least(count(*), 20) as journaled, count(*) - least(count(*), 20) as suppressed from journal group by 1, 2, 3", "journal"))
def quota(spark, sf):
    return a.quota(b.journal(spark, sf))


@query("l8_sliding_freshness", sql("""select layer, k * 300 as start, count(*) as events from (select layer, unnest(range((t - 3600) // 300 + 1, t // 300 + 1)) as k from geo_events) group by 1, 2""", "geo_events"))
def sliding(spark, sf):
    return a.sliding_freshness(b.geo_events(spark, sf), 3600, 300)


@query("l9_sessions", sql("""select id, session, min(t) as opened, max(t) as closed, count(*) as events from (select *, sum(new) over (partition by id order by t, seq rows unbounded preceding)::bigint as session from
    (select *, case when t - lag(t) over (partition by id order by t, seq) > 14400 is not false then 1 else 0 end as new from fixes)) group by id, session""", "fixes"))
def sessions(spark, sf):
    return a.sessions(b.fixes(spark, sf), "id", 14_400)
