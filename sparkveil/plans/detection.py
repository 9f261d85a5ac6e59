"""Queries of suffix rules and of ranked candidates; the SQL of the latter names the expected lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection as d
from ..operators import suffixes as s
from ..sources import bindings as b
from .registry import query, sql

#: Rules of all kinds, as published.
RULES = (
    "// rules of all kinds", "com", "org", "net", "test", "uk", "co.uk", "org.uk", "jp", "ac.jp", "co.jp", "kyoto.jp", "ide.kyoto.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "*.mm", "uk.com", "ac", "com.ac",
    "us", "ak.us", "k12.ak.us", "biz", "br", "com.br", "au", "com.au", "io", "github.io", "de", "fr", "es",
)


def rules(spark):
    return s.parsed_rules(spark.createDataFrame([(r,) for r in RULES], "rule string"))


_ENDS = ("co.uk", "kobe.jp", "city.kobe.jp", "ck", "www.ck", "mm", "github.io", "k12.ak.us", "unlisted", "uk", "Com.", "c.kobe.jp")
_HOSTS = "select page_id, host || '.' || ['" + "', '".join(_ENDS) + f"'][(page_id % {len(_ENDS)})::int + 1] as host from page_hosts union all select page_id, ['" + "', '".join(_ENDS) + f"'][(page_id % {len(_ENDS)})::int + 1] from page_hosts"


@query("e8_suffix_rules", sql(f"""with h as ({_HOSTS}),
    r as (select regexp_replace(rule, '^(!|\\*\\.)', '') as key, rule, case when rule[1] = '!' then len(string_split(rule, '.')) - 1 else len(string_split(rule, '.')) end as n, (rule[1] = '!')::int as e from (select unnest([{', '.join(f"'{r}'" for r in RULES[1:])}]) as rule)),
    l as (select distinct host, string_split(regexp_replace(lower(host), '\\.$', ''), '.') as l from h),
    best as (select host, arg_max(n, (e, n)) as n from (select host, n, e from l, r where list_slice(l, -len(string_split(key, '.')), -1) = string_split(key, '.') and n <= len(l)) group by host)
    select page_id, host, array_to_string(list_slice(l, -coalesce(n, 1), -1), '.') as suffix, case when len(l) > coalesce(n, 1) then array_to_string(list_slice(l, -coalesce(n, 1) - 1, -1), '.') end as registrable
    from h join l using (host) left join best using (host)""", "page_hosts"))
def suffix_rules(spark, sf):
    end = "element_at(array('" + "', '".join(_ENDS) + f"'), cast(page_id % {len(_ENDS)} as int) + 1)"
    pages = b.page_hosts(spark, sf)
    hosts = pages.selectExpr("page_id", f"concat(host, '.', {end}) as host").unionByName(pages.selectExpr("page_id", f"{end} as host"))
    return s.with_registrable(hosts, rules(spark))


#: Tokens of a key k, and the candidates that they have, best first: (token, [(type, normal form, confidence)]); both are SQL.
TOKENS = (
    ("'203.0.113.' || k % 250", [("ip", "'203.0.113.' || k % 250", 1.0)]), ("'2001:DB8:0:0::' || k % 9", [("ip", "'2001:db8::' || case when k % 9 > 0 then (k % 9)::{s} else '' end", 1.0)]),
    ("'10.0.' || k % 200 || '.77/24'", [("netblock", "'10.0.' || k % 200 || '.0/24'", 1.0)]), ("'2001:db8:1::/32'", [("netblock", "'2001:db8::/32'", 1.0)]), ("'as' || k", [("asn", "'AS' || k", 1.0)]),
    ("'Example' || k || '.COM'", [("domain", "'example' || k || '.com'", 0.95)]), ("'mail.h' || k || '.co.uk.'", [("hostname", "'mail.h' || k || '.co.uk'", 0.95)]), ("'Ann.B' || k || '@Example.com'", [("email", "'ann.b' || k || '@example.com'", 0.99)]),
    ("'https://example.com/A?x=' || k", [("url", "'https://example.com/A?x=' || k", 1.0)]), ("'cve-2024-' || (1000 + k)", [("vulnerability", "'CVE-2024-' || (1000 + k)", 1.0)]), ("'00-11-22-AA-BB-' || (10 + k % 90)", [("wifi_ap", "'00:11:22:aa:bb:' || (10 + k % 90)", 0.95)]),
    ("'0x52908400098527886E0F7030069857D2E41' || (10000 + k % 90000)", [("eth_address", "'0x52908400098527886e0f7030069857d2e41' || (10000 + k % 90000)", 1.0)]), ("'1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN' || (2 + k % 2)", []),
    ("'D41D8CD98F00B204E9800998ECF' || (10000 + k % 90000)", [("hash", "'d41d8cd98f00b204e9800998ecf' || (10000 + k % 90000)", 0.9)]), ("'GB82WEST12345698765432'", [("iban", "'GB82WEST12345698765432'", 0.95)]), ("'GB83WEST12345698765432'", []),
    ("'@Name_' || k", [("username", "'name_' || k", 0.9)]), ("'+49 30 1234' || (100 + k % 900)", [("phone", "'+49301234' || (100 + k % 900)", 0.95)]), ("'(415) 555-' || (1000 + k % 9000)", [("phone", "'415555' || (1000 + k % 9000)", 0.7)]),
    ("'48.5, ' || (k % 90) || '.25'", [("geo_point", "'48.500000,' || (k % 90) || '.250000'", 1.0)]), ("'48.5S ' || (k % 90) || '.25W'", [("geo_point", "'-48.500000,-' || (k % 90) || '.250000'", 1.0)]), ("'IMO ' || (1000000 + k)", [("vessel", "(1000000 + k)::{s}", 0.95)]),
    ("'310-410-' || k % 9000 || '-5'", [("cell_tower", "'310-410-' || k % 9000 || '-5'", 0.9)]), ("'36699' || (1000 + k % 9000)", [("vessel", "'36699' || (1000 + k % 9000)", 0.6)]), ("'99999' || (1000 + k % 9000)", [("vessel", "'99999' || (1000 + k % 9000)", 0.3)]),
    ("(10000 + k % 9000)::{s}", [("satellite", "(10000 + k % 9000)::{s}", 0.35)]), ("'A1b2' || (10 + k % 90)", [("aircraft", "'a1b2' || (10 + k % 90)", 0.45)]), ("'ABC' || (100 + k % 900)", [("aircraft", "'abc' || (100 + k % 900)", 0.45), ("aircraft", "'ABC' || (100 + k % 900)", 0.35)]),
    ("'example.org/path' || k", [("url", "'https://example.org/path' || k", 0.8)]), ("'hello world ' || k", []), ("'not_a_domain'", []), ("'x' || k || '.invalidtld'", []),
)


def _expected(string: str) -> str:
    lists = ["concat_ws(';', " + ", ".join(f"'{t}|' || {n.format(s=string)} || '|{c}'" for t, n, c in found) + ")" if found else "''" for _, found in TOKENS]
    return "case k % " + str(len(TOKENS)) + " " + " ".join(f"when {i} then {x}" for i, x in enumerate(lists)) + " end"


def _token(string: str) -> str:
    return "case k % " + str(len(TOKENS)) + " " + " ".join(f"when {i} then {t.format(s=string)}" for i, (t, _) in enumerate(TOKENS)) + " end"


@query("c1_ranked_candidates", f"""with t as (select c_custkey as k from customer), x as (select k as target, {_token('varchar')} as token, {_expected('varchar')} as candidates from t)
    select target, token, case when token = '1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2' then 'btc_address|' || token || '|0.98' else candidates end as candidates from x""")
def candidates(spark, sf):
    tokens = b.load(spark, sf, "customer").selectExpr("c_custkey as k").selectExpr("k as target", f"{_token('string')} as token")
    found = d.ranked(tokens, "token", rules(spark))
    return found.select("target", "token", F.array_join(F.transform("candidates", lambda c: F.concat_ws("|", c["type"], c["normalized"], c["confidence"].cast("string"))), ";").alias("candidates"))


#: Values of a type and their normal form, in SQL.
FORMS = (
    ("credit_card", "'4111-1111-1111-' || (1000 + k % 9000)", "'411111******' || (1000 + k % 9000)"), ("company", "'  Acme   Widgets ' || k", "'acme widgets ' || k"), ("person", "'Ann  Lee'", "'ann lee'"), ("lei", "'5493 001kj tiigc8y1r ' || (10 + k % 90)", "'5493001KJTIIGC8Y1R' || (10 + k % 90)"),
    ("phone", "'+1 (415) 555-' || (1000 + k % 9000)", "'+1415555' || (1000 + k % 9000)"), ("ip", "'::FFFF:0:' || k % 9", "case when k % 9 = 0 then '::ffff:0:0' else '::ffff:0:' || k % 9 end"), ("netblock", "'10.1.2.' || k % 200", "'10.1.2.' || k % 200 || '/32'"), ("ip", "'no address ' || k", "'no address ' || k"),
    ("description", "' As it Is ' || k", "'As it Is ' || k"), ("iban", "'gb82 west 1234 ' || k", "'GB82WEST1234' || k"), ("geo_point", "'1.5 ' || k % 90", "'1.500000,' || k % 90 || '.000000'"), ("domain", "'Ex' || k || '.ORG..'", "'ex' || k || '.org'"),
)


def _by(parts: list[str]) -> str:
    return f"case k % {len(FORMS)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(parts)) + " end"


@query("c5_normal_forms", f"select k as target, {_by([repr(t) for t, _, _ in FORMS])} as type, {_by([v for _, v, _ in FORMS])} as value, {_by([n for _, _, n in FORMS])} as normalized from (select c_custkey as k from customer)")
def forms(spark, sf):
    rows = b.load(spark, sf, "customer").selectExpr("c_custkey as k").selectExpr("k as target", f"{_by([repr(t) for t, _, _ in FORMS])} as type", f"{_by([v for _, v, _ in FORMS])} as value")
    return rows.withColumn("normalized", d.normal(F.col("type"), F.col("value")))
