"""Registry of the library's queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import GROUPS, MIXED_BITS, OCTETS, mixed_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under ``name``."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _ip(s: str) -> str:
    return f"concat_ws('.', 10 + ({s}) % 200, (({s}) * 7) % 256, (({s}) * 13) % 256, (({s}) * 29) % 254 + 1)"


def _num(s: str) -> str:
    return f"((10 + ({s}) % 200) * 16777216 + ((({s}) * 7) % 256) * 65536 + ((({s}) * 13) % 256) * 256 + (({s}) * 29) % 254 + 1)"


def _bits(k: str) -> str:
    """The address of ``k`` as 128 bits from the left, worked out from its numbers and not from its text."""
    four = " | ".join(f"(({x.format(k=k)})::uhugeint << {120 - 8 * i})" for i, x in enumerate(OCTETS))
    six = " | ".join(f"(({x.format(k=k)})::uhugeint << {112 - 16 * i})" for i, x in enumerate(GROUPS))
    return f"case when {k} % 101 = 0 then null when {k} % 3 = 0 then {four} else {six} end"


def _mixed(k: str, table: str, columns: str) -> str:
    return f"select {columns}, {mixed_text(k, 'lower(to_hex(({})::bigint))').replace('as string', 'as varchar')} as ip, case when {k} % 101 = 0 then null when {k} % 3 = 0 then 4 else 6 end as family, {_bits(k)} as num from {table}"


_LAT = "cast(({k} * 7919{a}) % 17000 as double) / 100::double - 85::double"
_LON = "cast(({k} * 104729{b}) % 36000 as double) / 100::double - 180::double"

#: The derived tables of ``sources.bindings`` in SQL.
BINDINGS = {
    "fixes": f"""select event_id as seq, event_id // 500 as batch, 'aviation:' || user_id as id, epoch_us(ts) // 1000000 - (event_id % 7) * 600 as t,
        {_LAT.format(k='event_id', a='')} as lat, {_LON.format(k='event_id', b='')} as lon, case when event_id % 11 = 0 then null else value * 30 end as alt,
        case when event_id % 5 = 0 then null else ((event_id * 37) % 360)::double end as heading,
        case when event_id % 3 = 0 then null else ((event_id * 53) % 900)::double end as speed,
        case when event_id % 4 = 0 then null else 'CS' || (event_id % 97) end as name from events""",
    "geo_events": """select event_id as seq, event_id // 500 as batch, 'ev:' || (event_id % 2000) as key, event_type as layer, epoch_us(ts) // 1000000 as t, value as mag,
        case when event_id % 50 = 0 then 'ev:' || ((event_id * 31) % 2000) end as supersedes from events""",
    "addresses": f"select c_custkey as target, {_ip('c_custkey')} as ip, {_num('c_custkey')} as ip_num from customer",
    "networks": f"""select provider, prefix_len, region, n - n % (1::bigint << (32 - prefix_len)) as lo, n - n % (1::bigint << (32 - prefix_len)) + (1::bigint << (32 - prefix_len)) - 1 as hi
        from (select s_name as provider, (8 + s_suppkey % 17)::int as prefix_len, {_num('s_suppkey')} as n, s_nationkey as region from supplier)""",
    "blocks": f"""select provider, prefix_len, n - n % (1::bigint << (32 - prefix_len)) as lo, n - n % (1::bigint << (32 - prefix_len)) + (1::bigint << (32 - prefix_len)) - 1 as hi
        from (select 'block' || c_custkey as provider, (10 + c_custkey % 15)::int as prefix_len, {_num('c_custkey')} as n from customer)""",
    "mixed_addresses": _mixed("c_custkey", "customer", "c_custkey as target"),
    "mixed_networks": f"""select *, lo + case when prefix_len = 0 then 340282366920938463463374607431768211455::uhugeint else (1::uhugeint << (128 - prefix_len)::uhugeint) - 1 end as hi from
        (select provider, ip || '/' || prefix_len as cidr, region, family, prefix_len::int as prefix_len, case when prefix_len = 0 then 0::uhugeint else (num >> (128 - prefix_len)::uhugeint) << (128 - prefix_len)::uhugeint end as lo
        from (select *, {MIXED_BITS.format(k="s_suppkey").replace("/ 40)", "// 40)")} as prefix_len from ({_mixed("s_suppkey", "supplier", "s_suppkey, s_name as provider, s_nationkey as region")})) where num is not null)""",
    "page_hosts": "select page_id, url, lower(regexp_extract(url, '//([^/:?#]+)', 1)) as host from pages",
    "indicators": f"""select distinct * from (select 'host' as kind, lower(regexp_extract(url, '//([^/:?#]+)', 1)) as key, 'hosts' as list from pages where page_id % 10 = 0
        union all select 'url', url, 'urls' from pages where page_id % 7 = 0 union all select 'ip', {_ip('c_custkey')}, 'addresses' from customer where c_custkey % 3 = 0)""",
    "claims": f"""select c_custkey as target, 'vendor' || v as vendor, case when (c_custkey + v) % 7 = 0 then null else (c_nationkey + case when (c_custkey * (v + 1)) % 5 = 0 then 1 else 0 end) % 25 end as country,
        64500 + (c_custkey + case when (c_custkey + v) % 6 = 0 then 1 else 0 end) % 40 as asn, {_LAT.format(k='c_custkey', a=' + v * 3')} as lat, {_LON.format(k='c_custkey', b=' + v * 5')} as lon,
        (1 + (c_custkey * (v + 3)) % 200)::int as radius_km, ((c_custkey * (v + 2)) % 60)::int as age_days from customer, (select unnest([0, 1, 2]) as v)""",
    "emissions": f"""select o_orderkey as seq, o_orderkey // 100 as run, ['ip', 'domain', 'email', 'person'][(o_orderkey % 4)::int + 1] as type, 'C' || o_custkey as value,
        cast(o_orderkey % 100 as double) / 100::double as confidence, epoch_us(o_orderdate) // 1000000 as t, case when o_orderkey % 3 = 0 then null else {_LAT.format(k='o_orderkey', a='')} end as lat,
        case when o_orderkey % 3 = 0 then null else {_LON.format(k='o_orderkey', b='')} end as lon, o_orderpriority as meta_key, o_orderstatus as meta_value from orders""",
    "relations": """select o_custkey as src, l_suppkey + 1000000000 as dst, 'rel_' || l_returnflag as rel, 'm' || l_linenumber as module,
        cast((l_orderkey * 7 + l_linenumber) % 100 as double) / 100::double as confidence from lineitem join orders on l_orderkey = o_orderkey""",
    "journal": """select event_id as seq, epoch_us(ts) // 1000000 as t, case event_type when 'error' then 'poll.error' when 'view' then 'poll.ok' when 'signup' then 'sink.stats' when 'click' then 'log' when 'purchase' then 'metric' end as kind,
        'feed' || (user_id % 10) as module, 'request ' || event_id || ' to host-' || user_id || ' failed after ' || (event_id % 30) || '.' || (event_id % 10) || 's at 0x' || lower(to_hex(event_id)) as message,
        event_id % 50 as rows, value from events""",
}


def sql(body: str, *tables: str) -> str:
    """``body`` with the named derived tables in front."""
    extra = body.lstrip()
    if not tables:
        return extra
    head = "with " + ", ".join(f"{t} as ({BINDINGS[t]})" for t in tables)
    if extra.lower().startswith("with "):
        return f"{head}, {extra[5:]}"
    return f"{head} {extra}"
