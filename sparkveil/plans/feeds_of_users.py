"""Queries of declared lists: samples are written by Spark, read through the data source and matched."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lists as l
from ..sources import bindings as b
from ..sources.list_source import ListDefinition, read_list
from ..streaming.run import shared_dir
from .registry import query

_K = "c_custkey"
_IP = f"concat_ws('.', 10 + {_K} % 200, ({_K} * 7) % 256, ({_K} * 13) % 256, ({_K} * 29) % 254 + 1)"
_LINE = f"""case {_K} % 10 when 0 then concat({_IP}, ' # seen twice') when 1 then concat('AS', 64000 + {_K}) when 2 then concat('asn', 64000 + {_K}) when 3 then concat('10.', {_K} % 256, '.0.7/16') when 4 then concat('0.0.0.0 Ads', {_K}, '.Example.com')
    when 5 then concat('http://Bad', {_K}, '.example.org/x') when 6 then '; comment' when 7 then '127.0.0.1 localhost' when 8 then upper(md5(c_name)) else concat('2001:DB8:0::', {_K} % 9, '/64') end"""
_CSV = f"""case {_K} % 5 when 0 then concat('"2024","', {_IP}, '","first, ', c_name, '"') when 1 then concat('2024,', lower(c_mktsegment), {_K}, '.example.net,') when 2 then 'only one' when 3 then concat('2024,,', c_name) else '# note' end"""
_PIPES = f"case when {_K} % 3 = 0 then concat('x|AS', {_K}, '|spam') when {_K} % 3 = 1 then concat('x|', {_IP}, '|scan') else 'x' end"


def _written(spark, sf, line: str, header: str | None = None) -> str:
    path = f"{shared_dir(spark)}/list-{uuid.uuid4().hex}"
    rows = b.load(spark, sf, "customer").selectExpr(f"{line} as line")
    if header:  # every file has one
        rows = rows.repartition(2).mapInPandas(lambda it: _headed(it, header), "line string")
    rows.write.text(path)
    return path


def _headed(batches, header: str):
    import pandas as pd

    first = True
    for batch in batches:
        if first:
            yield pd.DataFrame({"line": [header]})
            first = False
        yield batch


_LINES_SQL = f"""l as (select {_K} as k, c_name, {_IP} as ip from customer),
    feed as (select 'ip' as kind, ip as value from l where k % 10 = 0 union all select 'asn', (64000 + k)::varchar from l where k % 10 in (1, 2) union all select 'network', '10.' || k % 256 || '.0.0/16' from l where k % 10 = 3 union all select 'host', 'ads' || k || '.example.com' from l where k % 10 = 4
    union all select 'url', 'http://Bad' || k || '.example.org/x' from l where k % 10 = 5 union all select 'host', 'bad' || k || '.example.org' from l where k % 10 = 5 union all select 'hash', md5(c_name) from l where k % 10 = 8 union all select 'network', '2001:db8::/64' from l where k % 10 = 9)"""


@query("n3_declared_lists", f"""with {_LINES_SQL}, c as (select {_K} as k, c_name, lower(c_mktsegment) as seg, {_IP} as ip from customer)
    select 'lines' as list, null as category, kind, value, null as note, null as reject, count(*) as n from feed group by all
    union all select 'csv', 'phish', case k % 5 when 0 then 'ip' when 1 then 'host' end, case k % 5 when 0 then ip when 1 then seg || k || '.example.net' end, case k % 5 when 0 then 'first, ' || c_name when 3 then c_name end, case k % 5 when 2 then 'too few fields' when 3 then 'no indicator' end, count(*) from c where k % 5 < 4 group by all
    union all select 'pipes', null, case k % 3 when 0 then 'asn' when 1 then 'ip' end, case k % 3 when 0 then k::varchar when 1 then ip end, case k % 3 when 0 then 'spam' when 1 then 'scan' end, case k % 3 when 2 then 'too few fields' end, count(*) from c group by all""")
def declared(spark, sf):
    """Three lists of different form with their rejected lines."""
    lists = [
        (_LINE, None, ListDefinition("lines")), (_CSV, "day,indicator,said", ListDefinition("csv", "csv", 1, 2, skip_header=True, category="phish")),
        (_PIPES, None, ListDefinition("pipes", column=1, note_column=2, delimiter="|")),
    ]
    out = None
    for line, header, definition in lists:
        rows = read_list(spark, _written(spark, sf, line, header), definition)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("list", "category", "kind", "value", "note", "reject").agg(F.count("*").alias("n"))


@query("a15_user_feeds", f"""with {_LINES_SQL}, d as (select distinct kind, value from feed),
    t as (select k as target, 'ip' as kind, ip as value from l union all select k, 'asn', (64000 + k)::varchar from l union all select k, 'host', 'ads' || k || '.example.com' from l union all select k, 'hash', md5(c_name) from l union all select k, 'url', 'http://Bad' || k || '.example.org/x' from l)
    select target, kind, value, 'mine' as list, 'own' as category, case kind when 'asn' then 0.9::double when 'hash' then 0.98::double else 0.95::double end as confidence from t join d using (kind, value)
    union all select target, 'network', d.value, 'mine', 'own', 0.8::double from t join d on t.kind = 'ip' and d.kind = 'network' and starts_with(t.value, regexp_extract(d.value, '^(10\\.[0-9]+\\.)0\\.0/16$', 1)) and starts_with(d.value, '10.')""")
def feeds(spark, sf):
    """What a user's own feed says of addresses, AS numbers, hosts, digests and URLs."""
    feed = read_list(spark, _written(spark, sf, _LINE), ListDefinition("mine", category="own"))
    kinds = {"ip": _IP, "asn": f"concat(case when {_K} % 3 = 0 then 'as' when {_K} % 3 = 1 then 'ASN' else '' end, 64000 + {_K})", "host": f"concat('ads', {_K}, '.example.com')", "hash": "upper(md5(c_name))", "url": f"concat('http://Bad', {_K}, '.example.org/x')"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e).alias("value")) for k, e in kinds.items()]))
    targets = b.load(spark, sf, "customer").select(F.col(_K).alias("target"), pairs.alias("p")).select("target", "p.*")
    return l.feed_matches(targets, feed).drop("note")
