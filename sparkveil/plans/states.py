"""Queries of the state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import states as s
from ..sources import bindings as b
from .registry import query, sql

_SETTERS = "setters as (select * from (select *, max(t) over (partition by id order by seq rows between unbounded preceding and 1 preceding) as m from fixes) where m is null or t >= m)"


@query("h1_last_in_batch", sql("select seq, batch, key, layer, t, mag, supersedes from (select *, row_number() over (partition by batch, key order by seq desc) as r from geo_events) where r = 1", "geo_events"))
def last_in_batch(spark, sf):
    return s.last_per_key(b.geo_events(spark, sf), ["batch", "key"], ["seq"])


@query("h3_record_setters", sql(f"with {_SETTERS} select seq, id, t from setters", "fixes"))
def setters(spark, sf):
    return s.record_setters(b.fixes(spark, sf)).select("seq", "id", "t")


@query("h9_position_advanced", sql("select seq, id, t from (select *, max(t) over (partition by id order by seq rows between unbounded preceding and 1 preceding) as m from fixes) where m is null or t > m", "fixes"))
def advanced(spark, sf):
    return s.advanced(b.fixes(spark, sf)).select("seq", "id", "t")


@query("k1_event_upsert", sql("select seq, batch, key, layer, t, mag, supersedes from (select *, row_number() over (partition by key, t order by batch desc, seq desc) as r from geo_events) where r = 1", "geo_events"))
def upsert(spark, sf):
    return s.last_per_key(b.geo_events(spark, sf), ["key", "t"], ["batch", "seq"])


@query("k2_k3_revisions", sql(f"""with stored as (select seq, batch, key, layer, t, mag, supersedes from (select *, row_number() over (partition by key, t order by batch desc, seq desc) as r from geo_events) where r = 1)
    select * from stored a where not exists (select 1 from stored z where z.key = a.key and z.batch > a.batch and abs(z.t - a.t) <= {s.WEEK_S})
    and not exists (select 1 from geo_events z where z.supersedes = a.key and z.layer = a.layer and z.batch > a.batch and abs(z.t - a.t) <= {s.WEEK_S})""", "geo_events"))
def revisions(spark, sf):
    return s.revised(b.geo_events(spark, sf))


@query("k4_track_state", sql(f"""with {_SETTERS} select id, arg_max(t, seq) as t, arg_max(lat, seq) as lat, arg_max(lon, seq) as lon,
    first(alt order by seq desc) as alt, arg_max(name, seq) filter (name is not null) as name, arg_max(heading, seq) filter (heading is not null) as heading,
    arg_max(speed, seq) filter (speed is not null) as speed from setters group by id""", "fixes"))
def track_state(spark, sf):
    return s.track_state(b.fixes(spark, sf))


@query("k5_position_history", sql("select seq, batch, id, t, lat, lon, alt, heading, speed, name from (select *, row_number() over (partition by id, t order by seq) as r from fixes) where r = 1", "fixes"))
def history(spark, sf):
    return s.position_history(b.fixes(spark, sf))


@query("k6_downsampled_history", sql("""with recursive o as (select *, row_number() over (partition by id order by seq) as n from fixes),
    f as (select id, n, seq, t, t as kept, true as keep from o where n = 1
    union all select o.id, o.n, o.seq, o.t, case when o.t - f.kept >= 86400 then o.t else f.kept end, o.t - f.kept >= 86400 from f join o on o.id = f.id and o.n = f.n + 1)
    select id, seq, t from f where keep""".replace("with recursive ", "with "), "fixes").replace("with ", "with recursive ", 1))
def downsampled(spark, sf):
    return s.downsampled(b.fixes(spark, sf).select("id", "seq", "t"), gap_s=86_400)


@query("f4_entity_upsert", sql("""with last as (select type, value, meta_key, arg_max(meta_value, seq) as v from emissions group by all),
    meta as (select type, value, string_agg(meta_key || '=' || v, ';' order by meta_key || '=' || v) as meta from last group by all)
    select type, value, max(confidence) as confidence, min(t) as first_seen, max(t) as last_seen, count(*) as observations, arg_max(lat, (t, seq)) filter (lat is not null) as lat,
    arg_max(lon, (t, seq)) filter (lat is not null) as lon, any_value(meta) as meta from emissions join meta using (type, value) group by type, value""", "emissions"))
def entities(spark, sf):
    return s.entities(b.emissions(spark, sf))


@query("f5_relation_upsert", sql("select src, dst, rel, module, max(confidence) as confidence from relations group by all", "relations"))
def edges(spark, sf):
    return s.edges(b.relations(spark, sf))


@query("f7_degree", sql("select node, count(*) as degree from (select src as node from relations union all select dst from relations) group by node", "relations"))
def degree(spark, sf):
    return s.degrees(b.relations(spark, sf))


@query("k14_investigation_graph", sql("""with nodes as (select c_custkey as id, c_acctbal as seen from customer union all select s_suppkey + 1000000000, s_acctbal from supplier), kept as (select id from nodes order by seen desc, id limit 2000)
    select src, dst, rel, count(*) as lines from relations where src in (select id from kept) and dst in (select id from kept) group by all""", "relations"))
def graph(spark, sf):
    nodes = b.load(spark, sf, "customer").selectExpr("c_custkey as id", "c_acctbal as seen").union(b.load(spark, sf, "supplier").selectExpr("s_suppkey + 1000000000", "s_acctbal"))
    return s.subgraph(nodes, b.relations(spark, sf), 2000).groupBy("src", "dst", "rel").agg(F.count("*").alias("lines"))


@query("k15_k_hop", sql("""with recursive ends as (select distinct src as a, dst as b from relations union select distinct dst, src from relations),
    h as (select c_custkey as node, 0 as hops from customer where c_custkey % 100 = 0 union select b, hops + 1 from h join ends on a = node where hops < 2)
    select node, min(hops)::int as hops from h group by node""".replace("with recursive ", "with "), "relations").replace("with ", "with recursive ", 1))
def k_hop(spark, sf):
    seeds = b.load(spark, sf, "customer").where("c_custkey % 100 = 0").selectExpr("c_custkey as id")
    return s.k_hop(seeds, b.relations(spark, sf), 2)


@query("k11_snapshot_delta", sql("""with sn as (select id, max(t) as t, arg_max(lat, (t, seq)) as v from fixes where seq % 3 > 0 and hash_free % 4 > 0 group by id), d as (select id, max(t) as t, arg_max(lat, (t, seq)) as v from fixes where seq % 3 = 0 group by id)
    select coalesce(sn.id, d.id) as id, case when sn.t is null or d.t > sn.t then d.t else sn.t end as t, case when sn.t is null or d.t > sn.t then d.v else sn.v end as v
    from sn full join d on sn.id = d.id where sn.t is not null or d.t > 1706400000""".replace("hash_free", "cast(split_part(id, ':', 2) as bigint)"), "fixes"))
def snapshot(spark, sf):
    f = b.fixes(spark, sf)
    newest = lambda df: df.groupBy("id").agg(F.max("t").alias("t"), F.max_by("lat", F.struct("t", "seq")).alias("v"))
    return s.reconciled(newest(f.where("seq % 3 > 0 and cast(substring_index(id, ':', -1) as bigint) % 4 > 0")), newest(f.where("seq % 3 = 0")), 1_706_400_000)


@query("k12_expiry", sql("select id, max(t) as t from fixes group by id having max(t) >= 1706400000 - 21600", "fixes"))
def expiry(spark, sf):
    return s.expired(b.fixes(spark, sf).groupBy("id").agg(F.max("t").alias("t")), 1_706_400_000, 21_600)


@query("k10_layer_window", sql("select seq, key, layer, t from geo_events where layer in ('view', 'click') and t between 1705000000 - 86400 and 1705000000 + 1800 order by t desc, seq desc limit 5000", "geo_events"))
def window(spark, sf):
    seen = b.geo_events(spark, sf).where(F.col("layer").isin("view", "click") & F.col("t").between(1_705_000_000 - 86_400, 1_705_000_000 + 1_800))
    return seen.orderBy(F.col("t").desc(), F.col("seq").desc()).limit(5000).select("seq", "key", "layer", "t")


@query("e12_parent_resolution", sql("""select e.seq, e.type, e.value, min(p.seq) as parent_seq, count(p.seq) = 0 as missing from emissions e left join emissions p on p.value = e.value and p.type = e.type and p.run < e.run group by all""", "emissions"))
def parents(spark, sf):
    return s.resolved_parents(b.emissions(spark, sf))


@query("e13_position_track", sql("select f.id, f.seq, f.lat, f.lon, z.t as state_t from fixes f join (select id, max(t) as t from fixes group by id) z on f.id = z.id and f.t > z.t - 3600", "fixes"))
def positions(spark, sf):
    f = b.fixes(spark, sf)
    state = f.groupBy("id").agg(F.max("t").alias("state_t"))
    return f.join(state, "id").where("t > state_t - 3600").select("id", "seq", "lat", "lon", "state_t")


@query("e22_already_seen", sql("select seq, type, value from emissions e where not exists (select 1 from emissions o where o.run < e.run and o.type = e.type and o.value = e.value)", "emissions"))
def unseen(spark, sf):
    return s.first_seen(b.emissions(spark, sf))
