"""Nested documents with odd parts, places on tiles against a plain loop, sidereal time against known values."""

import math

from pyspark.sql import functions as F

from sparkveil.functions import geo
from sparkveil.operators import reports


def test_contacts(spark):
    deep = '{"entities": [{"handle": "a", "entities": [{"handle": "b", "entities": [{"handle": "c", "entities": [{"handle": "d", "entities": [{"handle": "e"}]}]}]}]}]}'
    odd = '{"entities": [{"vcardArray": ["vcard", [["FN", {}, "text", "X Org"], ["org", {}, "text", "X Org"], ["adr", {}, "text", "2 One Line"], ["tel", {}, "text", "tel:22"], ["email"], 3]], "roles": "none"}, null, {"vcardArray": "no"}]}'
    raw = spark.createDataFrame([(1, deep), (2, odd), (3, "{"), (4, None), (5, '{"entities": {}}'), (6, "[]")], "k int, raw string")
    rows = reports.contacts(raw, "k").collect()
    assert sorted((r.depth, r.handle) for r in rows if r.k == 1) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    x = next(r for r in rows if r.k == 2 and r.name)
    assert (x.kind, x.org, x.addresses, x.phones, x.emails, x.roles, x.country) == ("org", "X Org", ["2 One Line"], ["22"], [], [], None)
    assert {r.k for r in rows} == {1, 2}


def test_port_scan(spark):
    xml = '<nmaprun><host><address addr="::1" addrtype="ipv6"/><ports><port protocol="tcp" portid="443"><service name="https" product="Apache"/></port></ports></host><host><status state="down"/><address addr="1.1.1.1" addrtype="ipv4"/></host><host><address addr="00:11" addrtype="mac"/></host></nmaprun>'
    raw = spark.createDataFrame([(1, "banner <?xml version='1.0'?>" + xml), (2, "<nmaprun/>"), (3, None), (4, "")], "k int, raw string")
    rows = {(r.k, r.host, r.kind, r.value, r.port, r.confidence) for r in reports.port_scan(raw, "k").collect()}
    assert rows == {(1, "::1", "ip", "::1", None, 1.0), (1, "::1", "open_port", "::1:443", 443, 1.0), (1, "::1", "software", "Apache", None, 1.0), (1, "00:11", "ip", "00:11", None, 1.0)}


def test_findings(spark):
    lines = ['{"host": "h", "template-id": "t", "info": {"severity": "Low"}}', '{"host": "h"}', "[1]", "", None, '{"host": "h", "template-id": "u", "info": {"classification": {"cve-id": ["cve-1-1"]}}}']
    raw = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "k int, raw string")
    assert {(r.k, r.kind, r.value, r.severity) for r in reports.findings(raw, "k").collect()} == {(0, "finding", "t", "low"), (5, "vulnerability", "CVE-1-1", None)}


def test_tiles_share_their_edges(spark):
    points = [(k, lat, lon) for k, (lat, lon) in enumerate([(0.0, 0.0), (0.001, -0.001), (51.5, -0.1), (85.06, 0.0), (10.0, 180.0), (-85.0, -180.0), (None, 1.0), (66.51326, 90.0)])]
    rows = geo.on_tiles(spark.createDataFrame(points, "k int, lat double, lon double"), 2).collect()
    expected = set()
    for k, lat, lon in points:
        if lat is None or abs(lat) > 85.05112878:
            continue
        x, y = (lon + 180) / 360 * 4 * 4096, (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * 4 * 4096
        expected |= {(k, tx, ty, math.floor(x - tx * 4096 + 0.5), math.floor(y - ty * 4096 + 0.5)) for tx in range(4) for ty in range(4) if tx * 4096 - 64 <= x < (tx + 1) * 4096 + 64 and ty * 4096 - 64 <= y < (ty + 1) * 4096 + 64}
    assert {(r.k, r.tile_x, r.tile_y, r.px, r.py) for r in rows} == expected and len(rows) == len(expected) and sum(r.k == 0 for r in rows) == 4


def test_sidereal_time(spark):
    # 1 January 2000, noon: 280.4606 degrees; a sidereal day later the same.
    row = spark.range(1).select(F.degrees(geo.sidereal(F.lit(946_728_000))).alias("a"), F.degrees(geo.sidereal(F.lit(946_728_000 + 86_164.0905))).alias("b"), *geo.earth_fixed(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(946_728_000))).first()
    assert abs(row.a - 280.46062) < 1e-3 and abs(row.b - row.a) < 1e-3
    assert abs(math.hypot(row[2], row[3]) - 1000) < 1e-6 and row[4] == 2000
