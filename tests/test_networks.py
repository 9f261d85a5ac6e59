"""Addresses and networks of both families against Python's ``ipaddress``."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import networks as n


def written(r):
    """A random address in one of its written forms, with what it is."""
    if r.random() < 0.4:
        a = ipaddress.IPv4Address(r.choice([r.getrandbits(32), r.getrandbits(24) | 10 << 24, r.getrandbits(16) | 0xC0A80000, 0xC0000009, 0xFFFFFFFF]))
        return str(a), a
    top = r.choice([0x2001, 0x2A00, 0xFE80, 0xFD00, 0, 0x2002, 0x64FF, 0xFF02, 0x2600])
    a = ipaddress.IPv6Address(top << 112 | r.choice([0, r.getrandbits(16) << 96]) | r.choice([0, 0xFFFF << 32, r.getrandbits(64)]) | r.getrandbits(r.choice([1, 16, 32])))
    forms = [str(a), a.exploded, a.exploded.upper(), f" {a} "]
    if not int(a) >> 48:
        forms.append(f"::{int(a) >> 32 & 0xFFFF:x}:{ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)}")
    return r.choice(forms), a


BAD = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "::1::", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1", "1:", "::1.2.3", "::1.2.3.400", "a.b.c.d", "1:2:3:4:5:6:7::8", None]


@pytest.fixture(scope="module")
def seen(spark):
    r = random.Random(3)
    rows = [(k, *written(r)) for k in range(600)]
    return {k: a for k, _, a in rows}, n.located(spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000 + i, b) for i, b in enumerate(BAD)], "target long, ip string")).cache()


def test_forms(seen):
    known, df = seen
    rows = df.select("*", n.digits().alias("digits"), n.canonical().alias("text"), n.reverse_name().alias("name"), n.is_public().alias("public")).collect()
    assert len(rows) == len(known) + len(BAD)
    for r in rows:
        a = known.get(r.target)
        if a is None:
            ok = r.ip is not None and r.ip in ("1:2:3:4:5:6:7::8",)
            assert (r.family is None and r.text is None) or ok, r
            continue
        assert r.family == a.version and r.digits == (f"{int(a):032x}" if a.version == 6 else f"{int(a):08x}" + "0" * 24)
        assert r.name == a.reverse_pointer
        plain = a.version == 4 or a.ipv4_mapped is None
        if plain:
            assert r.text == a.compressed
        assert r.public == (a.is_global and not a.is_multicast if plain else a.ipv4_mapped.is_global and not a.ipv4_mapped.is_multicast), r


def test_networks(spark, seen):
    """Every prefix length, 0 included, free bits set, bad ones; each join against every pair."""
    known, df = seen
    r = random.Random(4)
    pool = list(known.values())
    cidrs = [(f"n{k}", f"{a}/{r.choice([0, 1, 5, 7, 8, 9, 24, 31, 32] if a.version == 4 else [0, 3, 7, 8, 16, 63, 64, 65, 127, 128])}") for k, a in enumerate(r.choices(pool, k=80))]
    cidrs += [("n80", "0.0.0.0/0"), ("n81", "::/0"), ("n82", str(pool[0]))]
    bad = [("b0", "1.2.3.4/33"), ("b1", "::/129"), ("b2", "x/8"), ("b3", "1.2.3.4/"), ("b4", None), ("b5", "1.2.3.4/8/8")]
    nets = n.parsed(spark.createDataFrame(cidrs + bad, "provider string, cidr string"))
    real = {p: ipaddress.ip_network(c, strict=False) for p, c in cidrs}
    hits = {(x.target, x.provider) for x in n.in_networks(df, nets).collect()}
    assert hits == {(k, p) for k, a in known.items() for p, net in real.items() if a.version == net.version and a in net}
    best = {x.target: (x.prefix_len, x.provider) for x in n.longest_prefix(df, nets, ["provider"]).collect()}
    for k, a in known.items():
        inside = [(-net.prefixlen, p) for p, net in real.items() if a.version == net.version and a in net]
        assert best.get(k) == ((-min(inside)[0], min(inside)[1]) if inside else None)
    pairs = [(x.a_provider, x.b_provider) for x in n.overlapping(nets, nets).collect()]
    expected = {(p, q) for p, a in real.items() for q, b in real.items() if a.version == b.version and a.overlaps(b)}
    assert set(pairs) == expected and len(pairs) == len(expected)
    few = [(x.provider, x.target, x.place) for x in n.first_members(df, nets, most=3, salts=4).collect()]
    for p, net in real.items():
        order = sorted(((int(a), k) for k, a in known.items() if a.version == net.version and a in net))[:3]
        assert sorted((place, t) for q, t, place in few if q == p) == [(i + 1, k) for i, (_, k) in enumerate(order)]


def test_short_prefixes_are_spread(spark):
    """Addresses of a network of no bits meet it under as many keys as their first bytes."""
    nets = n.parsed(spark.createDataFrame([("all", "0.0.0.0/0")], "provider string, cidr string"))
    seen = n.located(spark.range(256).select(F.col("id").alias("target"), F.concat(F.col("id"), F.lit(".1.1.1")).alias("ip")))
    assert n._keyed(nets).select("_hi").distinct().count() == 256 and n.in_networks(seen, nets).count() == 256
    assert n.in_networks(seen.where("false"), nets).count() == 0 and n.in_networks(seen, nets.where("false")).count() == 0
