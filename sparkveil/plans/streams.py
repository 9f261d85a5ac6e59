"""Queries that read the tables as streams and give what the streams end with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import states
from ..sources import bindings as b
from ..streaming import run, tracks
from .registry import ORACLES, query, sql


def _fixes(spark, sf):
    events = run.stream_of(spark, sf, "events", run.BATCH_BYTES)
    return events.selectExpr(
        "cast(ts as timestamp) as ts", "event_id as seq", "concat('aviation:', user_id) as id", "unix_seconds(cast(ts as timestamp)) - (event_id % 7) * 600 as t",
        "cast((event_id * 7919) % 17000 as double) / 100D - 85D as lat", "cast((event_id * 104729) % 36000 as double) / 100D - 180D as lon", "if(event_id % 11 = 0, null, value * 30) as alt",
        "if(event_id % 5 = 0, null, cast((event_id * 37) % 360 as double)) as heading", "if(event_id % 3 = 0, null, cast((event_id * 53) % 900 as double)) as speed", "if(event_id % 4 = 0, null, concat('CS', event_id % 97)) as name",
    )


@query("l3_stream_track_state", ORACLES["k4_track_state"])
def track_state(spark, sf):
    updates = run.drain(tracks.latest_tracks(_fixes(spark, sf)), "update")
    return states.last_per_key(updates, ["id"], ["batch"]).drop("batch").select("id", "t", "lat", "lon", "alt", "name", "heading", "speed")


@query("l4_stream_downsample", ORACLES["k6_downsampled_history"])
def downsample(spark, sf):
    return run.drain(tracks.thinned(_fixes(spark, sf), 86_400)).select("id", "seq", "t")


@query("l5_stream_distinct", "select distinct user_id, event_type as layer from events")
def distinct(spark, sf):
    events = run.stream_of(spark, sf, "events").selectExpr("cast(ts as timestamp) as ts", "user_id", "event_type as layer")
    return run.drain(tracks.distinct_keys(events, ["user_id", "layer"])).select("user_id", "layer")


@query("l7_stream_slots", "select epoch_us(ts) // 900000000 * 900 as slot, event_type as layer, count(*) as events from events group by 1, 2")
def slots(spark, sf):
    events = run.stream_of(spark, sf, "events").selectExpr("cast(ts as timestamp) as ts", "event_type as layer")
    updates = run.drain(tracks.slots(events), "update").select(F.unix_seconds("window.start").alias("slot"), "layer", "events", "batch")
    return states.last_per_key(updates, ["slot", "layer"], ["batch"]).drop("batch")


@query("l11_stream_indicator_match", sql("select page_id, host, list from page_hosts join indicators on kind = 'host' and key = host", "page_hosts", "indicators"))
def match(spark, sf):
    pages = run.stream_of(spark, sf, "pages").selectExpr("page_id", "lower(regexp_extract(url, '//([^/:?#]+)', 1)) as host")
    return run.drain(tracks.matched(pages, b.indicators(spark, sf).where("kind = 'host'"), "host")).select("page_id", "host", "list")
