"""Links of odd pages and other contents against hand-written cases; addresses against urllib."""

import random
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from sparkveil.operators import blobs


def test_addresses_like_urljoin(spark):
    r = random.Random(6)
    parts = ["a", "b.html", "..", ".", "", "c d", "x?y=1", "?q", "#f", "//h.example/z", "/root", "https://o.example/p"]
    rows = []
    for i in range(400):
        href = "/".join(r.choice(parts[:6]) for _ in range(r.randint(1, 4))) + r.choice(["", "", "?q=/../x", "#f"]) if i % 2 else r.choice(parts)
        rows.append((i, r.choice(["https://h.example/a/b/c", "http://h.example/a/", "http://h.example/a/b?x=/y"]), href))
    got = {x.i: x.t for x in spark.createDataFrame(rows, "i int, base string, href string").select("i", blobs.resolved(F.col("base"), F.col("href")).alias("t")).collect()}
    for i, base, href in rows:
        if href.strip() and not href.startswith("//") and "//" not in href.split("?")[0].replace("https://", ""):
            assert got[i] == urldefrag(urljoin(base, href))[0], (base, href)


def test_links_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "https://h.example/d/p", "<A HREF = one><a title='>' href=\"two\"><a href=javascript:x()><base href='/late/'><aside href=no>"), (2, "https://h.example", None), (3, None, "<a href=x>"), (4, "https://h.example/", "<iframe src='f'><a href='  '>")], "page_id int, url string, html string")
    assert {(r.page_id, r.via, r.target) for r in blobs.all_links(pages).collect()} == {(1, "link", "https://h.example/late/one"), (4, "frame", "https://h.example/f")}


def test_uris_and_secrets(spark):
    texts = spark.createDataFrame([(1, "data:;base64,aGk data:a/b;base64,aGk= x"), (2, "data:text/plain;base64,a"), (3, None), (4, "DATA:x;base64,-_-_")], "k int, text string")
    assert {(r.k, r.mime, r.bytes) for r in blobs.data_uris(texts, "k").collect()} == {(1, "text/plain", 2), (1, "a/b", 2), (4, "x", 3)}
    row = spark.range(1).select(blobs.without_known(F.lit("abcdef abcd abc"), ["abcd", "abcdef", "abc"]).alias("t"), blobs.account_country(F.lit("GB82WEST12345698765432")).alias("c"), blobs.account_country(F.lit(None).cast("string")).alias("n")).first()
    assert tuple(row) == ("*** *** abc", "GB", None)
