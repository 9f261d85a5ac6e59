"""Intelligence tables derived from the star-schema and event tables.

Every function is a projection of one given table with integer arithmetic only, so the work of the
operators on them grows with the tables and a SQL engine can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parts import dealt_by


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ipv4(s: str) -> str:
    """Expression of the dotted address of an integer expression."""
    return f"concat_ws('.', cast(10 + ({s}) % 200 as string), cast((({s}) * 7) % 256 as string), cast((({s}) * 13) % 256 as string), cast((({s}) * 29) % 254 + 1 as string))"


def ipv4_number(s: str) -> str:
    return f"((10 + ({s}) % 200) * 16777216 + ((({s}) * 7) % 256) * 65536 + ((({s}) * 13) % 256) * 256 + (({s}) * 29) % 254 + 1)"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position fixes of tracks: (seq, batch, id, t, lat, lon, alt, heading, speed, name)."""
    return load(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        "event_id div 500 as batch",
        "concat('aviation:', user_id) as id",
        "unix_seconds(cast(ts as timestamp)) - (event_id % 7) * 600 as t",
        "cast((event_id * 7919) % 17000 as double) / 100D - 85D as lat",
        "cast((event_id * 104729) % 36000 as double) / 100D - 180D as lon",
        "if(event_id % 11 = 0, null, value * 30) as alt",
        "if(event_id % 5 = 0, null, cast((event_id * 37) % 360 as double)) as heading",
        "if(event_id % 3 = 0, null, cast((event_id * 53) % 900 as double)) as speed",
        "if(event_id % 4 = 0, null, concat('CS', event_id % 97)) as name",
    )


def geo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisable geo events: (seq, batch, key, layer, t, mag, supersedes)."""
    return load(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        "event_id div 500 as batch",
        "concat('ev:', event_id % 2000) as key",
        "event_type as layer",
        "unix_seconds(cast(ts as timestamp)) as t",
        "value as mag",
        "if(event_id % 50 = 0, concat('ev:', (event_id * 31) % 2000), null) as supersedes",
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen addresses, one per customer: (target, ip, ip_num)."""
    return load(spark, sf_dir, "customer").selectExpr("c_custkey as target", f"{ipv4('c_custkey')} as ip", f"{ipv4_number('c_custkey')} as ip_num")


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published ranges, one per supplier: (provider, prefix_len, lo, hi, region)."""
    base = load(spark, sf_dir, "supplier").selectExpr("s_name as provider", "cast(8 + s_suppkey % 17 as int) as prefix_len", f"{ipv4_number('s_suppkey')} as ip_num", "s_nationkey as region")
    size = F.expr("shiftleft(1L, 32 - prefix_len)")
    return base.select("provider", "prefix_len", "region", (F.col("ip_num") - F.col("ip_num") % size).alias("lo"), (F.col("ip_num") - F.col("ip_num") % size + size - 1).alias("hi"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target netblocks, one per customer: (provider, prefix_len, lo, hi)."""
    base = load(spark, sf_dir, "customer").selectExpr("concat('block', c_custkey) as provider", "cast(10 + c_custkey % 15 as int) as prefix_len", f"{ipv4_number('c_custkey')} as n")
    size = F.expr("shiftleft(1L, 32 - prefix_len)")
    lo = F.col("n") - F.col("n") % size
    return base.select("provider", "prefix_len", lo.alias("lo"), (lo + size - 1).alias("hi"))


#: Expressions of an integer ``k``: the octets of its IPv4 address, and the groups of its IPv6 address (global, local, mapped and multicast ones).
OCTETS = ("({k} * 37) % 256", "({k} * 7) % 256", "({k} * 13) % 256", "({k} * 29) % 254 + 1")
GROUPS = (
    "case {k} % 8 when 0 then 8193 when 1 then 10752 when 2 then 9728 when 3 then 65152 when 4 then 64768 when 5 then 100 when 6 then 0 else 65282 end",
    "case when {k} % 5 = 0 or {k} % 16 = 6 then 0 else ({k} * 7) % 65536 end", "case when {k} % 4 = 0 then ({k} * 11) % 65536 else 0 end", "0", "0",
    "case when {k} % 16 = 6 then 65535 else 0 end", "({k} * 13) % 65536", "({k} * 29) % 65536",
)


def mixed_text(k: str, to_hex: str) -> str:
    """Expression, in Spark's and DuckDB's SQL, of the address of ``k`` as text: dotted, whole or shortened groups, capitals, or none at all."""
    o, g = [f"({x.format(k=k)})" for x in OCTETS], [f"({x.format(k=k)})" for x in GROUPS]
    h = [to_hex.format(x) for x in g]
    tail = f"concat('::ffff:', cast(floor({g[6]} / 256) as int), '.', {g[6]} % 256, '.', cast(floor({g[7]} / 256) as int), '.', {g[7]} % 256)"
    short = f"case when {k} % 16 = 6 then {tail} else concat({h[0]}, ':', {h[1]}, ':', {h[2]}, '::', {h[6]}, ':', {h[7]}) end"
    six = f"case when {k} % 3 = 1 then concat_ws(':', {', '.join(h)}) else {short} end"
    four = f"concat_ws('.', {', '.join(f'cast({x} as string)' for x in o)})"
    return f"case when {k} % 101 = 0 then 'unknown' when {k} % 3 = 0 then {four} when {k} % 7 = 0 then upper({six}) else {six} end"


def mixed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen addresses of both families, one per customer: (target, ip); a few can't be read."""
    return load(spark, sf_dir, "customer").selectExpr("c_custkey as target", f"{mixed_text('c_custkey', 'lower(hex({}))')} as ip")


#: Prefix lengths of the suppliers' networks: few short ones, all lengths above.
MIXED_BITS = "case when {k} % 40 = 0 then ({k} / 40) % 8 when {k} % 3 = 0 then 8 + {k} % 25 when {k} % 40 = 1 then ({k} / 40) % 16 else 16 + ({k} * 5) % 113 end"


def mixed_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published networks of both families, one per supplier: (provider, cidr, region); free bits may be set."""
    bits = MIXED_BITS.format(k="s_suppkey").replace("/ 40)", "div 40)")
    return load(spark, sf_dir, "supplier").selectExpr("s_name as provider", f"concat({mixed_text('s_suppkey', 'lower(hex({}))')}, '/', {bits}) as cidr", "s_nationkey as region")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, host) of the saved pages."""
    return load(spark, sf_dir, "pages").selectExpr("page_id", "url", "lower(regexp_extract(url, '//([^/:?#]+)', 1)) as host")


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of indicators: (kind, key, list) with hosts of every tenth page and addresses of every third customer."""
    hosts = page_hosts(spark, sf_dir).where("page_id % 10 = 0").selectExpr("'host' as kind", "host as key", "'hosts' as list")
    urls = page_hosts(spark, sf_dir).where("page_id % 7 = 0").selectExpr("'url' as kind", "url as key", "'urls' as list")
    ips = addresses(spark, sf_dir).where("target % 3 = 0").selectExpr("'ip' as kind", "ip as key", "'addresses' as list")
    return hosts.unionByName(urls).unionByName(ips).distinct()


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geolocation claims of three vendors about every customer's address: (target, vendor, country, asn, lat, lon, radius_km, age_days)."""
    rows = load(spark, sf_dir, "customer").selectExpr("c_custkey as target", "c_nationkey as n", "explode(array(0, 1, 2)) as v")
    return rows.selectExpr(
        "target",
        "concat('vendor', v) as vendor",
        "if((target + v) % 7 = 0, null, (n + if((target * (v + 1)) % 5 = 0, 1, 0)) % 25) as country",
        "64500 + (target + if((target + v) % 6 = 0, 1, 0)) % 40 as asn",
        "cast((target * 7919 + v * 3) % 17000 as double) / 100D - 85D as lat",
        "cast((target * 104729 + v * 5) % 36000 as double) / 100D - 180D as lon",
        "cast(1 + (target * (v + 3)) % 200 as int) as radius_km",
        "cast((target * (v + 2)) % 60 as int) as age_days",
    )


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity emissions of collection runs: (seq, run, type, value, confidence, t, lat, lon, meta_key, meta_value)."""
    return emissions_of(load(spark, sf_dir, "orders"))


def emissions_of(orders: DataFrame) -> DataFrame:
    """The emissions of rows of ``orders``, which may be a stream."""
    return orders.selectExpr(
        "o_orderkey as seq",
        "o_orderkey div 100 as run",
        "element_at(array('ip', 'domain', 'email', 'person'), cast(o_orderkey % 4 as int) + 1) as type",
        "concat('C', o_custkey) as value",
        "cast(o_orderkey % 100 as double) / 100D as confidence",
        "unix_seconds(cast(o_orderdate as timestamp)) as t",
        "if(o_orderkey % 3 = 0, null, cast((o_orderkey * 7919) % 17000 as double) / 100D - 85D) as lat",
        "if(o_orderkey % 3 = 0, null, cast((o_orderkey * 104729) % 36000 as double) / 100D - 180D) as lon",
        "o_orderpriority as meta_key",
        "o_orderstatus as meta_value",
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between entities: customer to supplier by order line: (src, dst, rel, module, confidence)."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return dealt_by(lines, "l_orderkey").join(dealt_by(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_custkey as src", "l_suppkey + 1000000000 as dst", "concat('rel_', l_returnflag) as rel", "concat('m', l_linenumber) as module",
        "cast((l_orderkey * 7 + l_linenumber) % 100 as double) / 100D as confidence",
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed journal: (seq, t, kind, module, message, rows, value)."""
    kind = F.create_map(*[F.lit(x) for p in (("error", "poll.error"), ("view", "poll.ok"), ("signup", "sink.stats"), ("click", "log"), ("purchase", "metric")) for x in p])
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.expr("unix_seconds(cast(ts as timestamp))").alias("t"),
        kind[F.col("event_type")].alias("kind"),
        F.concat(F.lit("feed"), F.col("user_id") % 10).alias("module"),
        F.expr("concat('request ', event_id, ' to host-', user_id, ' failed after ', event_id % 30, '.', event_id % 10, 's at 0x', lower(hex(event_id)))").alias("message"),
        F.expr("event_id % 50").alias("rows"),
        F.col("value"),
    )
