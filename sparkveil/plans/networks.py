"""Queries of addresses and networks of both families; the SQL works on 128-bit numbers, never on the text."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import networks as n
from ..sources import bindings as b
from .registry import query, sql


def _seen(spark, sf) -> DataFrame:
    return n.located(b.mixed_addresses(spark, sf))


def _published(spark, sf) -> DataFrame:
    return n.parsed(b.mixed_networks(spark, sf))


_INSIDE = "mixed_addresses a join mixed_networks w on a.family = w.family and a.num between w.lo and w.hi"


@query("e2_networks_both_families", sql(f"select target, ip, provider, cidr, prefix_len, 0.8::double as confidence from {_INSIDE}", "mixed_addresses", "mixed_networks"))
def in_network(spark, sf):
    return n.in_networks(_seen(spark, sf), _published(spark, sf)).select("target", "ip", "provider", "cidr", "prefix_len", F.lit(0.8).alias("confidence"))


@query("e3_overlap_both_families", sql("""select a.provider as a_provider, a.cidr as a_cidr, w.provider as b_provider, w.cidr as b_cidr
    from mixed_networks a join mixed_networks w on a.family = w.family and a.lo <= w.hi and w.lo <= a.hi""", "mixed_networks"))
def overlap(spark, sf):
    return n.overlapping(_published(spark, sf), _published(spark, sf)).select("a_provider", "a_cidr", "b_provider", "b_cidr")


@query("e3_members_both_families", sql(f"""select provider, target, ip, place from
    (select provider, target, ip, row_number() over (partition by provider order by num, target)::int as place from {_INSIDE}) where place <= 50""", "mixed_addresses", "mixed_networks"))
def members(spark, sf):
    return n.first_members(_seen(spark, sf), _published(spark, sf))


@query("e9_longest_prefix_both_families", sql(f"""select target, ip, provider, prefix_len, region from
    (select target, ip, provider, prefix_len, region, row_number() over (partition by target order by prefix_len desc, provider) as r from {_INSIDE}) where r = 1""", "mixed_addresses", "mixed_networks"))
def longest(spark, sf):
    return n.longest_prefix(_seen(spark, sf), _published(spark, sf), ["provider", "region"])


@query("e10_hosting_both_families", sql(f"""select target, ip, provider, prefix_len, n_name as region_name, row_number() over (partition by target order by prefix_len desc, provider)::int as place
    from {_INSIDE} left join nation on region = n_nationkey""", "mixed_addresses", "mixed_networks"))
def hosting(spark, sf):
    found = n.in_networks(_seen(spark, sf), _published(spark, sf)).join(b.load(spark, sf, "nation"), F.col("region") == F.col("n_nationkey"), "left")
    return found.selectExpr("target", "ip", "provider", "prefix_len", "n_name as region_name", "row_number() over (partition by target order by prefix_len desc, provider) as place")


def _in(bits: int, *networks: str) -> str:
    """SQL of a number of ``bits`` bits that lies in one of the networks, by shifts."""
    shifts = [(bits - n.prefixlen, int(n.network_address) >> (bits - n.prefixlen)) for n in map(ipaddress.ip_network, networks)]
    return "(" + " or ".join(f"(num >> {s}) = {v}" for s, v in shifts) + ")"


_V4 = "not " + _in(32, "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3") + " or num in (3221225481, 3221225482)"
_V6 = "not " + _in(128, "::/127", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "ff00::/8") + " or " + _in(128, "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


@query("c6_public_both_families", sql(f"""select target, ip, null::boolean as public from mixed_addresses where num is null
    union all select target, ip, {_V4} from (select target, ip, (case family when 4 then num >> 96 else num & 4294967295 end)::bigint as num from mixed_addresses where family = 4 or num >> 32 = 65535)
    union all select target, ip, {_V6} from mixed_addresses where family = 6 and num >> 32 <> 65535""", "mixed_addresses"))
def public(spark, sf):
    return _seen(spark, sf).select("target", "ip", n.is_public().alias("public"))


@query("g8_reverse_both_families", sql("""select target, ip, case when family = 4 then concat_ws('.', (num >> 96) & 255, (num >> 104) & 255, (num >> 112) & 255, num >> 120) || '.in-addr.arpa'
    when family = 6 then array_to_string(list_transform(range(32), lambda k: lower(to_hex(((num >> (4 * k)::uhugeint) & 15::uhugeint)::bigint))), '.') || '.ip6.arpa' end as name from mixed_addresses""", "mixed_addresses"))
def reverse(spark, sf):
    return _seen(spark, sf).select("target", "ip", n.reverse_name().alias("name"))
