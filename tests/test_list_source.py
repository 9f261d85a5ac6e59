"""The data source of lists: lines of all forms, rejects, blocks of long files, streams of files."""

import os

import pytest

from sparkveil.operators import lists
from sparkveil.sources import list_source as s


def told(rows):
    return sorted(((r.kind or "", r.value or "", r.note, r.reject) for r in rows), key=str)


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n; c\n// c\n\n1.2.3.4 # note\n0.0.0.0 Ads.Example.com\n127.0.0.1 localhost\nAS64500\nasn7\n10.1.2.3/8\n::FFFF:0\nhttp://Ü.example/x\n" + "A" * 64 + "\nHost.Example.\n\"quoted.example\"\n999.1.1.1\n1.2.3.4/99\n")
    (tmp_path / "_SUCCESS").write_text("")
    rows = s.read_list(spark, str(tmp_path), s.ListDefinition("l", category="c", confidence=0.5)).collect()
    assert told(rows) == sorted([
        ("ip", "1.2.3.4", None, None), ("host", "ads.example.com", None, None), ("asn", "64500", None, None), ("asn", "7", None, None), ("network", "10.0.0.0/8", None, None), ("ip", "::ffff:0", None, None), ("url", "http://Ü.example/x", None, None),
        ("host", "ü.example", None, None), ("hash", "a" * 64, None, None), ("host", "host.example", None, None), ("host", "quoted.example", None, None), ("host", "999.1.1.1", None, None), ("host", "1.2.3.4/99", None, None),
    ], key=str)
    assert {(r.list, r.category, r.confidence) for r in rows} == {("l", "c", 0.5)} and {r.line for r in rows if r.value == "1.2.3.4"} == {5}


def test_csv_with_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('when,what,why\n1,"x.example","a, b"\n2\n3,"",n\n4,y.example\n')
    rows = s.read_list(spark, f"file://{tmp_path}/a.csv", s.ListDefinition("l", "csv", 1, 2, skip_header=True)).collect()
    assert told(rows) == sorted([("", "", None, "too few fields"), ("", "", "n", "no indicator"), ("host", "x.example", "a, b", None), ("host", "y.example", None, None)], key=str)


def test_bad_form(spark, tmp_path):
    with pytest.raises(Exception, match="lines or csv"):
        s.read_list(spark, str(tmp_path), s.ListDefinition("l", "xml")).count()


def test_blocks_hold_each_line_once(tmp_path, monkeypatch):
    lines = [f"h{i}.example" + "x" * (i % 40) for i in range(500)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    for size in (1, 7, 100, 4096):
        monkeypatch.setattr(s, "BLOCK", size)
        reader = s._Reader({"path": str(tmp_path), "name": "l"})
        parts = reader.partitions()
        assert sorted(r[4] for p in parts for r in reader.read(p)) == sorted(lines) and (len(parts) > 1) == (size < 10_000)


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, text, at: ((source / name).write_text(text), os.utime(source / name, (at, at)))
    put("b.txt", "1.1.1.1\n", 1_000)
    stream = s.read_list(spark, str(source), s.ListDefinition("l"), stream=True)
    state = str(tmp_path / "state")

    def more():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert more() == ["1.1.1.1"]
    put("a.txt", "2.2.2.2\n3.3.3.3\n", 2_000)
    assert more() == ["1.1.1.1", "2.2.2.2", "3.3.3.3"] and more() == ["1.1.1.1", "2.2.2.2", "3.3.3.3"]


def test_feed_matches(spark, tmp_path):
    (tmp_path / "a.txt").write_text("AS64500\n10.0.0.0/8\n10.1.0.0/16\n10.1.2.3\n2001:db8::/32\n10.1.2.3\n")
    feed = s.read_list(spark, str(tmp_path), s.ListDefinition("l", confidence=0.6))
    targets = spark.createDataFrame([(1, "asn", "asn64500"), (2, "asn", "64500"), (3, "ip", "10.1.2.3"), (4, "ip", "2001:db8::1"), (5, "ip", "nonsense"), (6, "asn", None)], "target int, kind string, value string")
    assert sorted((r.target, r.kind, r.value, r.confidence) for r in lists.feed_matches(targets, feed).collect()) == [
        (1, "asn", "64500", 0.6), (2, "asn", "64500", 0.6), (3, "ip", "10.1.2.3", 0.6), (3, "network", "10.0.0.0/8", 0.6), (3, "network", "10.1.0.0/16", 0.6), (4, "network", "2001:db8::/32", 0.6),
    ]
