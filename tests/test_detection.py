"""Public suffix rules against the published test vectors; ranked candidates and normal forms against hand-written cases."""

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import detection, suffixes
from sparkveil.plans.detection import rules

#: Host and registrable domain, as the rule list's published tests give them.
VECTORS = {
    "COM": None, "example.COM": "example.com", "WwW.example.COM": "example.com", ".com": None, ".example": None, ".example.com": None, "example": None, "example.example": "example.example", "b.example.example": "example.example",
    "a.b.example.example": "example.example", "biz": None, "domain.biz": "domain.biz", "b.domain.biz": "domain.biz", "a.b.domain.biz": "domain.biz", "com": None, "b.example.com": "example.com", "uk.com": None, "example.uk.com": "example.uk.com",
    "b.example.uk.com": "example.uk.com", "test.ac": "test.ac", "mm": None, "c.mm": None, "b.c.mm": "b.c.mm", "a.b.c.mm": "b.c.mm", "jp": None, "test.jp": "test.jp", "www.test.jp": "test.jp", "ac.jp": None, "test.ac.jp": "test.ac.jp",
    "www.test.ac.jp": "test.ac.jp", "kyoto.jp": None, "test.kyoto.jp": "test.kyoto.jp", "ide.kyoto.jp": None, "b.ide.kyoto.jp": "b.ide.kyoto.jp", "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp",
    "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": None, "test.ck": None, "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck",
    "us": None, "test.us": "test.us", "www.test.us": "test.us", "ak.us": None, "test.ak.us": "test.ak.us", "k12.ak.us": None, "test.k12.ak.us": "test.k12.ak.us", "www.test.k12.ak.us": "test.k12.ak.us",
}


def test_published_vectors(spark):
    hosts = spark.createDataFrame([(k, h) for k, h in enumerate([*VECTORS, None, "example.com", "example.com", ""])], "k int, host string")
    rows = suffixes.with_registrable(hosts, rules(spark)).collect()
    assert len(rows) == len(VECTORS) + 4
    assert {r.host: r.registrable for r in rows} == VECTORS | {None: None, "": None, "example.com": "example.com"}


def test_unlisted_suffixes_are_none(spark):
    hosts = spark.createDataFrame([("a.unlisted",), ("a.com",)], "host string")
    assert {r.host: (r.suffix, r.registrable) for r in suffixes.split_hosts(hosts, rules(spark), unlisted=False).collect()} == {"a.unlisted": (None, None), "a.com": ("com", "a.com")}


def test_rule_lines(spark):
    lines = spark.createDataFrame([("// note",), ("",), ("  Co.UK trailing words",), ("*.ck",), ("!www.ck",), ("co.uk",), (None,)], "rule string")
    assert sorted(tuple(r) for r in suffixes.parsed_rules(lines).collect()) == [("ck", "wildcard", 2), ("co.uk", "plain", 2), ("www.ck", "exception", 1)]


BEST = {
    "203.0.113.7": "ip", "2001:db8::1": "ip", "203.0.113.0/24": "netblock", "AS13335": "asn", "as13335": "asn", "example.com": "domain", "mail.example.co.uk": "hostname", "alice@example.com": "email",
    "https://example.com/login?x=1": "url", "CVE-2024-3094": "vulnerability", "00:11:22:33:44:55": "wifi_ap", "0x52908400098527886E0F7030069857D2E4169EE7": "eth_address", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2": "btc_address",
    "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq": "btc_address", "d41d8cd98f00b204e9800998ecf8427e": "hash", "GB82WEST12345698765432": "iban", "+442071838750": "phone", "@jdoe_42": "username", "48.8566, 2.3522": "geo_point",
    "48.8566N 2.3522E": "geo_point", "IMO 9811000": "vessel", "310-410-1234-56789": "cell_tower", "366999999": "vessel", "25544": "satellite", "a1b2c3": "aircraft", "529900T8BM49AURSDO55": "lei",
    "hello world": None, "not_a_domain": None, "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3": None, "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdx": None, "GB82WEST12345698765433": None, "": None, None: None, "  ": None, "99.5, 200": None, "10.0.0.0/33": None, "1.2.3.4.5": None,
}


@pytest.fixture(scope="module")
def ranked(spark):
    rows = spark.createDataFrame([(t, 1, "x") for t in BEST] + [("123456", 2, "y")], "token string, _host int, suffix string")
    return {r.token: r for r in detection.ranked(rows, "token", rules(spark)).collect()}


def test_best_candidate(ranked):
    assert {t: ranked[t].candidates[0].type if ranked[t].candidates else None for t in BEST} == BEST
    assert all(ranked[t]._host == 1 and ranked[t].suffix == "x" for t in BEST)  # columns of the caller


def test_order_of_candidates(ranked):
    assert [(c.type, c.confidence, c.key) for c in ranked["366999999"].candidates] == [("vessel", 0.6, "mmsi")]
    assert [(c.type, c.key) for c in ranked["123456"].candidates] == [("satellite", "norad")]
    for r in ranked.values():
        assert [c.confidence for c in r.candidates] == sorted((c.confidence for c in r.candidates), reverse=True)


def test_normal_forms(spark):
    cases = [
        ("ip", " 2001:DB8::0:1 ", "2001:db8::1"), ("ip", "nonsense", "nonsense"), ("netblock", "2001:db8::ff/32", "2001:db8::/32"), ("netblock", "::1", "::1/128"), ("email", "A.B@Ex.COM.", "a.b@ex.com"), ("wifi_ap", "AA-bb-CC-00-11-22", "aa:bb:cc:00:11:22"),
        ("credit_card", "4111 1111 1111 1111", "411111******1111"), ("geo_point", "48.8566, 2.35", "48.856600,2.350000"), ("geo_point", "x", "x"), ("url", " HTTP://X ", "HTTP://X"), ("asn", "as 12", "AS12"), ("keyword", " A  b ", "a b"), (None, " v ", "v"), ("ip", None, None),
    ]
    df = spark.createDataFrame([(k, t, v) for k, (t, v, _) in enumerate(cases)], "k int, type string, value string")
    got = {r.k: r.n for r in df.select("k", detection.normal(F.col("type"), F.col("value")).alias("n")).collect()}
    assert got == {k: n for k, (_, _, n) in enumerate(cases)}
