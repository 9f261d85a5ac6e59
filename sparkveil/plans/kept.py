"""Queries of kept state: the tables are filled batch by batch, the last one twice, and give what one recomputation gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kept as k
from ..operators.kept_index import KeptIndex
from ..sources import bindings as b
from ..streaming.run import shared_dir
from .registry import ORACLES, query


def _table(spark, name: str, schema, keys: list[str], fold, buckets: int = 16) -> k.KeptTable:
    return k.KeptTable(spark, f"{shared_dir(spark)}/kept-{name}-{uuid.uuid4().hex}", schema, keys, fold, buckets)


def _filled(table: k.KeptTable, rows: DataFrame, order: str, batches: int = 3) -> DataFrame:
    """All ``rows`` in batches by their share of ``order``."""
    most = rows.agg(F.max(order)).first()[0] or 0
    part = F.least(F.floor(F.col(order) * batches / (most + 1)), F.lit(batches - 1))
    for n in [*range(batches), batches - 1]:
        table.upsert(rows.where(part == n), n)
    return table.current()


@query("k4_kept_tracks", ORACLES["k4_track_state"])
def tracks(spark, sf):
    return _filled(_table(spark, "tracks", k.TRACK, ["id"], k.tracks), b.fixes(spark, sf), "seq").drop("seq")


@query("k1_kept_events", ORACLES["k1_event_upsert"])
def events(spark, sf):
    return _filled(_table(spark, "events", k.EVENT, ["key", "t"], k.events), b.geo_events(spark, sf), "batch")


@query("k5_kept_history", ORACLES["k5_position_history"])
def history(spark, sf):
    return _filled(_table(spark, "history", k.HISTORY, ["id", "t"], k.history), b.fixes(spark, sf), "seq")


@query("f4_kept_entities", ORACLES["f4_entity_upsert"])
def entities(spark, sf):
    emissions = b.emissions(spark, sf)
    table = _table(spark, "entities", k.ENTITY, ["type", "value"], k.entities)
    most = emissions.agg(F.max("run")).first()[0] or 0
    for n in (0, 1, 2, 2):
        table.upsert(k.entity_rows(emissions.where(F.floor(F.col("run") * 3 / (most + 1)) == n)), n)
    return k.described(table.current())


@query("f5_kept_edges", ORACLES["f5_relation_upsert"])
def edges(spark, sf):
    path = f"{shared_dir(spark)}/relations-{uuid.uuid4().hex}"
    b.relations(spark, sf).write.parquet(path)  # joined once, not for each batch
    return _filled(_table(spark, "edges", k.EDGE, ["src", "dst", "rel", "module"], k.edges), spark.read.parquet(path), "src")


@query("m6_kept_index", """with docs as (select p_partkey as id, p_type as type, 'L' || p_partkey % 5 as layer, p_brand as value, case when p_partkey % 4 = 1 then p_name || ' new' else p_name end as label,
        case when p_partkey % 3 = 0 then ['Alias ' || p_partkey, p_type] end as aliases, p_partkey % 5 as degree, p_partkey % 7 as seen from part where p_partkey % 13 > 0),
    asked as (select s_suppkey as qid, lower(trim(case s_suppkey % 5 when 0 then 'Brand#' || (10 + s_suppkey % 50) when 1 then substr(p_name, 1, 5) when 2 then substr(p_name, 3, 6) when 3 then 'alias ' || s_suppkey else 'x' || s_suppkey % 9 end)) as q, case when s_suppkey % 2 = 0 then 'L' || p_partkey % 5 end as layer from supplier join part on p_partkey = s_suppkey),
    h as (select docs.*, lower(unnest(list_concat([value, label], coalesce(aliases, [])))) as h from docs),
    hits as (select qid, id, max(case when h = q then 1.0 when starts_with(h, q) then 0.8 else 0.5 end)::double as score, any_value(degree) as degree, any_value(seen) as seen from asked join h on contains(h, q) and (asked.layer is null or asked.layer = h.layer) group by qid, id)
    select qid, id, score, place from (select *, row_number() over (partition by qid order by score desc, degree desc, seen desc, id)::int as place from hits) where place <= 20""")
def index(spark, sf):
    parts = b.load(spark, sf, "part")
    kept = KeptIndex(spark, f"{shared_dir(spark)}/kept-index-{uuid.uuid4().hex}", 16)
    told = lambda label, aliases: parts.selectExpr("p_partkey as id", "p_type as type", "concat('L', p_partkey % 5) as layer", "p_brand as value", f"{label} as label", f"{aliases} as aliases", "p_partkey % 5 as degree", "p_partkey % 7 as seen")
    old = told("concat('old ', p_name)", "cast(null as array<string>)").where("id % 2 = 0 or id % 13 = 0")
    new = told("if(p_partkey % 4 = 1, concat(p_name, ' new'), p_name)", "if(p_partkey % 3 = 0, array(concat('Alias ', p_partkey), p_type), null)")
    kept.add(old, 0)
    kept.add(new.where("id % 13 > 0"), 1, deleted=parts.where("p_partkey % 13 = 0").selectExpr("p_partkey as id"))
    both = b.load(spark, sf, "supplier").join(parts, F.col("p_partkey") == F.col("s_suppkey"))
    asked = both.selectExpr("s_suppkey as qid", "case s_suppkey % 5 when 0 then concat('Brand#', 10 + s_suppkey % 50) when 1 then substr(p_name, 1, 5) when 2 then substr(p_name, 3, 6) when 3 then concat('alias ', s_suppkey) else concat('x', s_suppkey % 9) end as q", "cast(null as array<string>) as types", "if(s_suppkey % 2 = 0, array(concat('L', p_partkey % 5)), null) as layers")
    return kept.search(asked)
