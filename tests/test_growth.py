"""Steps whose memory, time or bytes grew faster than the tables did."""

import pandas as pd

from sparkveil.functions import parts  # noqa: F401


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feeds_meet_in_a_given_number_of_parts(spark):
    from sparkveil.operators import lists

    feed = spark.createDataFrame([("l", None, None, "host", "a.b", None, None)], "list string, category string, confidence double, kind string, value string, note string, reject string")
    targets = spark.createDataFrame([(1, "host", "a.b"), (2, "host", "c.d")], "target long, kind string, value string")
    found = lists.feed_matches(targets, feed)
    assert "REPARTITION_BY_NUM" in _plan(found.where("kind = 'host'").select("target", "value", "note"))
    assert [x.target for x in found.collect()] == [1]


def test_prefixes_meet_in_a_given_number_of_parts(spark):
    from sparkveil.operators import matching

    targets = spark.createDataFrame([(1, "http://a.b/c/d"), (2, "http://a.b"), (3, "http://x.y/")], "target long, url string")
    listed = spark.createDataFrame([("http://a.b/c",), ("http://a.b/c/",), ("http://a.b/z",)], "key string")
    found = matching.url_prefix_matches(targets, listed)
    assert _plan(found).count("REPARTITION_BY_NUM") >= 5
    assert {x.target: x.listed for x in found.collect()} == {1: "http://a.b/c/", 2: "http://a.b/c/"}


def test_relations_are_joined_once_for_degrees(spark):
    from sparkveil.operators import states
    from sparkveil.sources import bindings

    plan = _plan(states.degrees(bindings.relations(spark, "/root/testdata/sf0.001")))
    assert plan.count("lineitem.parquet") == 1 and "REPARTITION_BY_NUM" in plan
    rows = spark.createDataFrame([(1, 2), (1, None), (2, 2)], "src long, dst long")
    assert {x.node: x.degree for x in states.degrees(rows).collect()} == {1: 2, 2: 3, None: 1}


def test_documents_meet_degrees_in_a_given_number_of_parts(spark):
    from sparkveil.operators import search

    entities = spark.createDataFrame([(1, "t", "v", "l"), (2, "t", "v", "l")], "id long, type string, value string, label string")
    found = search.with_degree(entities, spark.createDataFrame([(1, 5)], "node long, degree long"))
    assert "REPARTITION_BY_NUM" in _plan(found)
    assert {x.id: x.degree for x in found.collect()} == {1: 5, 2: 0}


def test_error_marks_let_every_hit_through(spark):
    from pyspark.sql import functions as F

    from sparkveil.operators import webintel

    hits = [
        "wArning: x in a.php", "Fatal error : x in y on line 3", "Stack trace: #0 ", "Traceback (most recent call last):", "WARNING: MYSQL_", "com.mysql.jdbc", "error:  SYNTAX error at or near", "ORG.postgresql.util.PSQL", "[SQL SERVER]", "System.Data.SqlClient",
        "ORA-12345", "SQLite::", "SQLITE3.operationalerror", "[Microsoft][ODBC", "odbc DRIVER", "server error in '/x' application", "system.x.Exception", "(NoMethodError)", "a.rb:3:in `", "at a.b (/x/y.js:1:2)", "java.lang.Error", "org.x.SomeException: b", "at a.b(C.java:3)",
        "/var/a", "/srv/b", "C:\\x", "db_password = 1", "\n API_KEY: x",
    ]
    assert len(webintel.MARKS) == len(webintel.ERRORS)
    rows = spark.createDataFrame([(h,) for h in hits], "text string").withColumn("low", F.lower("text"))
    both = [(F.col("text").rlike(p), webintel._marked("low", m)) for (_, p), m in zip(webintel.ERRORS, webintel.MARKS, strict=True)]
    found = rows.select("text", F.array(*[h for h, _ in both]).alias("hit"), F.array(*[h & ~m for h, m in both]).alias("lost")).collect()
    assert all(any(x.hit) and not any(x.lost) for x in found)


def test_state_of_a_track_takes_no_loop_over_its_fixes(monkeypatch):
    from sparkveil.streaming import tracks

    class State:
        hasTimedOut, exists, get = False, True, (5, 1.0, 1.0, None, "old", 7.0, None)

        def update(self, have):
            self.now = have

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, t):
            pass

    def no(*a, **b):
        raise AssertionError("rows are taken one by one")

    monkeypatch.setattr(pd.DataFrame, "itertuples", no)
    columns = ["seq", "t", "lat", "lon", "alt", "name", "heading", "speed"]
    rows = pd.DataFrame([(4, 9, 4.0, 4.0, None, None, None, 3.0), (1, 4, 9.0, 9.0, 9.0, "late", 9.0, 9.0), (2, 10, 2.0, 2.0, 2.0, "new", None, None), (3, 10, 3.0, 3.0, None, None, None, 8.0)], columns=columns)
    out = next(tracks._fold(("x",), iter([rows[:2], rows[2:]]), s := State()))
    assert s.now == (10, 3.0, 3.0, None, "new", 7.0, 8.0) and out["t"].tolist() == [10]
    list(tracks._fold(("x",), iter([rows[1:2]]), s))
    assert s.now == s.get  # a batch of late fixes alone changes nothing


def test_registration_records_are_parsed_once(spark):
    from sparkveil.operators import reports

    raw = '{"entities": [{"handle": "A", "entities": [{"handle": "B", "entities": [7, {"handle": "C", "entities": [{"handle": "D", "entities": [{"handle": "E"}]}]}]}]}, {"handle": "F"}]}'
    found = reports.contacts(spark.createDataFrame([(1, raw), (2, "{torn"), (3, "{}"), (4, None)], "id long, raw string"), "id")
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 1 or _plan(found).lower().count("parsejson") == 1
    assert sorted((x.id, x.depth, x.handle or "") for x in found.collect()) == [(1, 0, "A"), (1, 0, "F"), (1, 1, "B"), (1, 2, ""), (1, 2, "C"), (1, 3, "D")]


def test_kept_edges_join_their_relations_once(spark, monkeypatch):
    from sparkveil.plans import kept

    seen = []
    monkeypatch.setattr(kept, "_filled", lambda table, rows, order: seen.append(rows) or rows)
    kept.edges(spark, "/root/testdata/sf0.001")
    assert "Join" not in _plan(seen[0])
