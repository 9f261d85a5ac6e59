"""Queries of windows and ages on streams: what is closed once the watermark has passed the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ages, run, windows
from .registry import query


def _events(spark, sf):
    return run.stream_of(spark, sf, "events").selectExpr("cast(ts as timestamp) as ts", "user_id", "event_type as layer", "concat('e', event_id % 300) as id", "unix_seconds(cast(ts as timestamp)) as t")


def _mark(late_ms: int) -> str:
    """The watermark after all events, in milliseconds."""
    return f"(select epoch_us(max(ts)) // 1000 - {late_ms} from events)"


@query("l9_stream_sessions", f"""with o as (select user_id, epoch_us(ts) as u, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from
    (select *, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 14400000000 is not false)::int as fresh from events)),
    w as (select user_id, min(u) as opened_us, max(u) as closed_us, count(*) as events from o group by user_id, s)
    select * from w where closed_us // 1000 + 14400000 <= {_mark(7_200_000)}""")
def sessions(spark, sf):
    closed = run.drain(windows.sessions(_events(spark, sf), "user_id", "4 hours"))
    return closed.select("user_id", F.unix_micros("opened").alias("opened_us"), F.unix_micros("closed").alias("closed_us"), "events")


@query("l8_stream_sliding", f"""with w as (select event_type as layer, unnest(range((epoch_us(ts) - 3600000000) // 300000000 + 1, epoch_us(ts) // 300000000 + 1)) * 300 as start, epoch_us(ts) as u from events)
    select layer, start, count(*) as events, max(u) as newest_us from w group by 1, 2 having (start + 3600) * 1000 <= {_mark(600_000)}""")
def sliding(spark, sf):
    told = run.drain(windows.sliding(_events(spark, sf), "layer", "1 hour", "5 minutes"))
    return told.select("layer", F.unix_seconds("start").alias("start"), "events", F.unix_micros("newest").alias("newest_us"))


@query("l13_stream_layer_ages", f"""with a as (select * from (values ('view', 1200), ('click', 21600), ('signup', 86400)) as v(layer, age)),
    l as (select event_type as layer, 'e' || event_id % 300 as id, max(epoch_us(ts)) // 1000000 as t from events group by 1, 2)
    select layer, id, t, t + age as gone_at from l join a using (layer) where (t + age) * 1000 < {_mark(600_000)}""")
def layer_ages(spark, sf):
    """Things on three layers of 20 minutes, 6 hours and a day; those of other layers have no age."""
    layers = spark.createDataFrame([("view", 1200), ("click", 21_600), ("signup", 86_400), ("error", None)], "layer string, max_age_s long")
    with ages.kept_on_disk(spark):
        return run.drain(ages.removals(_events(spark, sf), layers)).select("layer", "id", "t", "gone_at")
