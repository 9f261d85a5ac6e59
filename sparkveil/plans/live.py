"""Queries of live feeds: tables read as streams, and what the streams end with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks, states
from ..sources import bindings as b
from ..streaming import live, run
from . import feeds, streams
from .registry import ORACLES, query


@query("l1_stream_positions", ORACLES["a6_vessels"])
def positions(spark, sf):
    lines = feeds.reports_of(feeds.positions_of(run.stream_of(spark, sf, "events")))
    return run.drain(live.positions(lines)).drop("batch")


@query("l6_future_slack", "select event_id, epoch_us(ts) // 1000000 + (event_id % 5) * 900 as t from events where event_id % 5 <= 2")
def timely(spark, sf):
    e = run.stream_of(spark, sf, "events").selectExpr("event_id", "unix_seconds(cast(ts as timestamp)) as arrived", "unix_seconds(cast(ts as timestamp)) + (event_id % 5) * 900 as t")
    return run.drain(live.timely(e, "arrived")).select("event_id", "t")


@query("l10_stream_layer_deltas", """with f as (select event_type as layer, 'f' || (user_id % 20) as id, event_id as seq, unnest(['value', 'name']) as k, unnest([case when event_id % 3 = 0 then null else event_id::varchar end, case when event_id % 4 = 0 then repeat('x', 600) else 'n' || user_id end]) as v from events)
    select layer, id, max_by(v, seq) filter (v is not null and len(v) <= 512 and k = 'value') as value, max_by(v, seq) filter (v is not null and len(v) <= 512 and k = 'name') as name from f group by all""")
def deltas(spark, sf):
    """What a client holds that applies the messages in order: field by field, the last message wins."""
    writes = run.stream_of(spark, sf, "events", run.BATCH_BYTES).selectExpr("event_type as layer", "concat('f', user_id % 20) as id", "event_id as seq", "map('value', if(event_id % 3 = 0, null, cast(event_id as string)), 'name', if(event_id % 4 = 0, repeat('x', 600), concat('n', user_id))) as props")
    messages = run.drain(writes, each=live.layer_messages)
    features = messages.select("batch", "layer", F.explode(F.from_json("message", "array<struct<id string, props string>>")).alias("f")).select("batch", "layer", "f.id", F.from_json("f.props", "value string, name string").alias("p"))
    last = lambda c: F.max_by(f"p.{c}", F.when(F.col(f"p.{c}").isNotNull(), F.col("batch"))).alias(c)
    return features.groupBy("layer", "id").agg(last("value"), last("name"))


@query("l12_stream_quality", ORACLES["f10_quality_checks"])
def quality(spark, sf):
    updates = run.drain(live.quality(b.emissions_of(run.stream_of(spark, sf, "orders")), 900_000_000), "update")
    return states.last_per_key(updates, ["type"], ["batch"]).drop("batch")


@query("l14_stream_merge", ORACLES["f3_aircraft_merge"])
def merged(spark, sf):
    fixes = streams._fixes(spark, sf).selectExpr("*", "element_at(array('adsb', 'mlat', 'tisb', 'other'), cast(seq % 4 as int) + 1) as source", "shiftleft(1L, cast(seq % 5 as int)) as flags")
    return states.last_per_key(run.drain(live.merged(fixes), "update"), ["id"], ["batch"]).drop("batch")


@query("b7_poison_rows", """select reason, count(*) as records, min(event_id) as first_id from (select event_id, case when event_id % 7 = 0 then 'no key' when event_id % 5 = 0 then 'bad value' when event_id % 11 = 0 then 'bad position' end as reason from events) group by 1""")
def poison(spark, sf):
    e = b.load(spark, sf, "events").selectExpr("event_id", "if(event_id % 7 = 0, null, concat('k', user_id)) as key", "if(event_id % 5 = 0, 'n/a', cast(value as string)) as value", "if(event_id % 11 = 0, 123.0D, 45.0D) as lat")
    good, bad = sinks.isolated(e, {"no key": F.col("key").isNotNull(), "bad value": F.col("value").try_cast("double").isNotNull(), "bad position": F.abs("lat") <= 90})
    both = good.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", "reason"))
    return both.groupBy("reason").agg(F.count("*").alias("records"), F.min("event_id").alias("first_id"))
