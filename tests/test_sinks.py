"""Reports, rows set apart, flushed streams and saved files, on small tables with odd rows."""

from pyspark.sql import functions as F

from sparkveil.operators import pages, sinks
from sparkveil.streaming import live


def test_poison_rows_leave_the_batch(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, "c", None), (4, None, None)], "n int, key string, lat double")
    good, bad = sinks.isolated(rows, {"no key": F.col("key").isNotNull(), "no place": F.col("lat") < 90})
    assert [r.n for r in good.collect()] == [1]
    assert {(r.n, r.reason) for r in bad.collect()} == {(2, "no key"), (3, "no place"), (4, "no key")}
    assert good.columns == rows.columns


def test_report_is_written_in_two_forms(spark, tmp_path):
    table = spark.createDataFrame([("b", 2), ("a|x", None)], "feed string, rows int")
    sinks.write_report(table, "feed", str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r/markdown")).collect()] == ["| feed | rows |", "|---|---|", "| a\\|x |  |", "| b | 2 |"]
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2
    assert sinks.markdown(table.where("false"), "feed").first().text == "| feed | rows |\n|---|---|"


def test_follow_flushes_bounded_batches(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sizes = []
    query = live.follow(stream, lambda batch, number: sizes.append(batch.count()), str(tmp_path / "state"), "100 milliseconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(sizes) == 40 and len([s for s in sizes if s]) == 4


def test_merge_keeps_its_fix_between_batches(spark, tmp_path):
    from sparkveil.streaming import run

    schema = "ts timestamp, id string, seq long, t long, lat double, lon double, name string, flags long, source string"
    for n, rows in enumerate([[("a", 1, 100, None, 1, "mlat")], [("a", 2, 101, "X", 2, "adsb"), ("a", 3, 100, "Y", 4, "other")], [("a", 4, 90, "Z", 8, "adsb")]]):
        df = spark.createDataFrame([(i, s, t, 0.0, float(s), name, f, src) for i, s, t, name, f, src in rows], "id string, seq long, t long, lat double, lon double, name string, flags long, source string")
        df.selectExpr("timestamp_seconds(t) as ts", "*").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    last = max(run.drain(live.merged(stream), "update").collect(), key=lambda r: r.batch)
    assert (last.seq, last.t, last.name, last.flags) == (2, 101, "X", 15)


def test_exposed_files_of_odd_answers(spark):
    long = "nothing to see at this address, please go back to where you came from and try again later "
    answers = spark.createDataFrame(
        [("h", "/a", 200, "secret"), ("h", "/b", 200, None), ("h", "/c", 206, long + "/c 1234567"), ("h", "/d", 200, long.replace("see", "sea") + "/d"), (None, "/e", 200, "x"), ("other", "/f", 200, "x"), ("h", None, 200, "y")],
        "host string, path string, status int, body string",
    )
    controls = spark.createDataFrame([("h", "/none", long + "/none 7654321"), ("h", "/none", long + "/none")], "host string, path string, body string")
    found = {(r.host, r.path) for r in pages.exposed_files(answers, controls).collect()}
    assert found == {("h", "/a"), ("h", None)}


def test_document_metadata_of_odd_files(spark):
    files = spark.createDataFrame(
        [(1, bytearray(b"%PDF-1.7 /Author (A\\)b) /Author (A\\)b) /ModDate (D:2024) /Creator()")), (2, None), (3, bytearray(b"")), (4, bytearray(b"/Author (x)")), (5, bytearray("%PDF- /Author (é)".encode("latin-1")))],
        "k int, content binary",
    )
    assert {(r.k, r.field, r.value) for r in pages.document_metadata(files, "k").collect()} == {(1, "Author", "A)b"), (5, "Author", "é")}


def test_address_forms_of_odd_pages(spark):
    rows = spark.createDataFrame([(1, "<p>{first}.{last}@ and {page}@ a@x.org A@X.ORG b@y.org", "x.org"), (2, None, "x.org"), (3, "a@x.org", None)], "k int, html string, domain string")
    assert {(r.k, r.kind, r.value) for r in pages.address_forms(rows, "k").collect()} == {(1, "email", "a@x.org"), (1, "email_pattern", "{first}.{last}@x.org")}
