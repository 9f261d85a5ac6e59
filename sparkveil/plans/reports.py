"""Queries of nested documents and of places on map tiles; the documents are written from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.parts import dealt_by
from ..operators import reports as r
from ..sources import bindings as b
from .registry import query, sql

_RECORD = """concat('{"entities": [{"handle": "H', c_custkey, '", "roles": ["registrant", "technical"], "vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", " ', c_name, ' "], ["org", {}, "text", ["', if(c_custkey % 2 = 0, c_name, 'Other'), '", "Unit"]],
    ["email", {}, "text", "Info', c_custkey, '@Example.com"], ["tel", {"type": "voice"}, "uri", "tel:+1.', c_custkey, '"], ["adr", {"cc": "us"}, "text", ["", "", "', c_custkey, ' Street", "", "", "", "Utopia"]], ["broken"]]],
    "entities": [{"handle": "N', c_custkey, '", "vcardArray": ["vcard", [["kind", {}, "text", "Individual"], ["fn", {}, "text", "Ann"], ["adr", {"label": "One\\\\nTwo"}, "text", ["", "", "", "", "", "", "Erehwon"]]]], "entities": [{"roles": ["abuse"]}]}]}, 7]}')"""


@query("a21_rdap_contacts", """select c_custkey as target, 0 as depth, 'H' || c_custkey as handle, 'registrant,technical' as roles, case when c_custkey % 2 = 0 then 'org' end as kind, c_name as name, case when c_custkey % 2 = 0 then c_name else 'Other' end as org,
    'info' || c_custkey || '@example.com' as emails, '+1.' || c_custkey as phones, c_custkey || ' Street, Utopia' as addresses, 'US' as country from customer where c_custkey % 10 > 0
    union all select c_custkey, 1, 'N' || c_custkey, '', 'individual', 'Ann', null, '', '', 'One, Two', 'Erehwon' from customer where c_custkey % 10 > 0
    union all select c_custkey, 2, null, 'abuse', null, null, null, '', '', '', null from customer where c_custkey % 10 > 0
    union all select c_custkey, 0, null, '', null, null, null, '', '', '', null from customer where c_custkey % 10 > 0""")
def contacts(spark, sf):
    raw = dealt_by(b.load(spark, sf, "customer"), "c_custkey").selectExpr("c_custkey as target", f"if(c_custkey % 10 = 0, '{{torn', {_RECORD}) as raw")
    found = r.contacts(raw, "target")
    return found.withColumns({c: F.array_join(c, ",") for c in ("roles", "emails", "phones", "addresses")})


_SCAN = """concat(if(target % 4 = 0, 'Starting scan\\n', ''), '<?xml version="1.0"?><nmaprun><host><status state="', if(target % 7 = 0, 'down', 'up'), '"/><address addr="00:11" addrtype="mac"/><address addr="', ip, '" addrtype="ipv4"/><ports>',
    '<port protocol="tcp" portid="', 80 + target % 9, '"><state state="open"/><service name="http" product="nginx" version="1.', target % 5, '"/></port><port protocol="udp" portid="53"><state state="closed"/></port><port portid="22"><state state="open"/></port></ports>',
    if(target % 3 = 0, '<os><osmatch name="Linux 5" accuracy="96"/><osmatch name="BSD" accuracy="90"/></os>', ''), '</host></nmaprun>')"""


@query("a22_nmap_report", sql("""select target, ip as host, kind, case kind when 'ip' then ip when 'open_port' then ip || ':' || p when 'software' then 'nginx 1.' || target % 5 else 'Linux 5' end as value, p as port, case when p = 22 or p is not null then 'tcp' end as proto,
    case when kind = 'open_port' and p <> 22 then 'http' end as service, case when kind = 'operating_system' then 0.96::double else 1.0::double end as confidence
    from (select *, unnest(['ip', 'open_port', 'open_port', 'software', 'operating_system']) as kind, unnest([null, 80 + target % 9, 22, null, null])::int as p from addresses) where target % 7 > 0 and (kind <> 'operating_system' or target % 3 = 0)""", "addresses"))
def scans(spark, sf):
    return r.port_scan(b.addresses(spark, sf).selectExpr("target", f"{_SCAN} as raw"), "target")


_FINDING = """case when target % 6 = 0 then 'no json' when target % 6 = 1 then concat('{"host": "', ip, '"}') else concat('{"template-id": "t-', target % 4, '", "host": "', ip, '", "info": {', if(target % 2 = 0, concat('"name": "Name ', target % 4, '", '), ''), '"severity": "HIGH"', if(target % 5 = 0, concat(', "classification": {"cve-id": ["cve-2024-', 1000 + target, '", "CVE-2020-1"]}'), ''), '}}') end"""


@query("a22_findings", sql("""select target, ip as host, 'vulnerability' as kind, unnest(['CVE-2024-' || (1000 + target), 'CVE-2020-1']) as value, 'high' as severity from addresses where target % 6 > 1 and target % 5 = 0
    union all select target, ip, 'finding', case when target % 2 = 0 then 'Name ' || target % 4 else 't-' || target % 4 end, 'high' from addresses where target % 6 > 1 and target % 5 > 0""", "addresses"))
def findings(spark, sf):
    return r.findings(b.addresses(spark, sf).selectExpr("target", f"{_FINDING} as raw"), "target")


@query("j11_tile_places", sql("""with w as (select seq, (lon + 180) / 360 * 4194304 as x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793::double) / 2 * 4194304 as y from fixes where lat between -85.05112878 and 85.05112878)
    select seq, tx::int as tile_x, ty::int as tile_y, floor(x - tx * 4096 + 0.5)::int as px, floor(y - ty * 4096 + 0.5)::int as py from w, lateral (select unnest(range(greatest(floor((x - 64) / 4096), 0)::bigint, least(floor((x + 64) / 4096), 1023)::bigint + 1)) as tx) a,
    lateral (select unnest(range(greatest(floor((y - 64) / 4096), 0)::bigint, least(floor((y + 64) / 4096), 1023)::bigint + 1)) as ty) c""", "fixes"))
def tiles(spark, sf):
    return geo.on_tiles(b.fixes(spark, sf).select("seq", "lat", "lon"), 10).drop("lat", "lon")


@query("j7_earth_fixed", sql("""with g as (select seq, t, (t / 86400::double + 2440587.5::double - 2451545.0::double) / 36525.0::double as c from fixes),
    s as (select seq, c, 67310.54841::double + (876600.0::double * 3600 + 8640184.812866::double) * c + 0.093104::double * c * c - 0.0000062::double * c * c * c as u from g), a as (select seq, radians((u - floor(u / 86400) * 86400) / 240) as a from s)
    select seq, round(a, 6) as angle, round((7000 * cos(a) + (seq % 1000) * sin(a)) * 1000, 1) as x, round(((seq % 1000) * cos(a) - 7000 * sin(a)) * 1000, 1) as y, (seq % 500) * 1000::double as z from a""", "fixes"))
def earth_fixed(spark, sf):
    f = b.fixes(spark, sf).selectExpr("seq", "t", "7000D as a", "cast(seq % 1000 as double) as b", "cast(seq % 500 as double) as c")
    x, y, z = geo.earth_fixed("a", "b", "c", "t")
    return f.select("seq", F.round(geo.sidereal("t"), 6).alias("angle"), F.round(x, 1).alias("x"), F.round(y, 1).alias("y"), z.alias("z"))
