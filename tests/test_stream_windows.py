"""Windows and ages over several batches: sessions that close, late rows, state that goes, layers of different ages."""

import os

import pytest

from sparkveil.streaming import ages, run, windows

SCHEMA = "ts timestamp, layer string, id string, t long"


@pytest.fixture
def stream(spark, tmp_path):
    def of(*batches):
        """One file, and so one batch, of (minute, layer, id) each."""
        for i, rows in enumerate(batches):
            values = ", ".join(f"({m}, '{layer}', '{id_}')" for m, layer, id_ in rows)
            spark.sql(f"select timestamp_seconds(m * 60) as ts, layer, id, cast(m * 60 as long) as t from values {values} as v(m, layer, id)").coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
            (found,) = (tmp_path / f"part{i}").glob("part-*.parquet")
            (tmp_path / "in").mkdir(exist_ok=True)
            os.utime(found.rename(tmp_path / "in" / f"{i}.parquet"), (1_000_000 + i, 1_000_000 + i))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return of


def ended(df, tmp_path):
    """The rows a stream gives, and the rows of its state at the end."""
    query = df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("memory").queryName("told").start()
    query.awaitTermination()
    left = query.lastProgress["stateOperators"][-1]["numRowsTotal"]
    return df.sparkSession.table("told").collect(), left


def test_sessions_close_and_state_goes(stream, tmp_path):
    events = stream([(0, "x", "a"), (20, "x", "a"), (50, "x", "a"), (10, "x", "b")], [(300, "x", "c")], [(301, "x", "c")], [(302, "x", "c"), (30, "x", "a")], [(1000, "x", "d")], [(1001, "x", "d")])
    # lateness is judged by the watermark that the batch before had
    rows, left = ended(windows.sessions(events, "id", "25 minutes", "60 minutes"), tmp_path)
    told = sorted((r.id, r.opened.minute + 60 * r.opened.hour, (r.closed - r.opened).seconds // 60, r.events) for r in rows)
    # a's last event at 30 came after the watermark had passed its session; d's session is still open and all that is left.
    assert told == [("a", 0, 20, 2), ("a", 50, 0, 1), ("b", 10, 0, 1), ("c", 300, 2, 3)] and left == 1


def test_sliding_windows(stream, tmp_path):
    events = stream([(0, "x", "a"), (7, "x", "a"), (7, "y", "b")], [(200, "x", "c")], [(201, "x", "c")], [(3, "x", "late"), (202, "x", "c")])
    rows, left = ended(windows.sliding(events, "layer", "10 minutes", "5 minutes", "30 minutes"), tmp_path)
    told = sorted((r.layer, int(r.start.timestamp()) // 60, r.events) for r in rows)
    assert told == [("x", -5, 1), ("x", 0, 2), ("x", 5, 1), ("y", 0, 1), ("y", 5, 1)] and left == 2  # two windows of the last events


def test_layers_of_different_ages_in_one_stream(spark, stream):
    layers = spark.createDataFrame([("ship", 1200), ("fire", 21_600), ("town", None)], "layer string, max_age_s long")
    reports = stream(
        [(1, "ship", "s1"), (1, "fire", "f1"), (1, "town", "t1"), (10, "ship", "s2")], [(25, "ship", "s2"), (60, "other", "o")], [(100, "ship", "s3"), (101, "fire", "f2")], [(490, "town", "t1"), (490, "ship", "s5")], [(500, "ship", "s4"), (500, "fire", "f1")], [(2000, "fire", "f3")], [(2001, "town", "t2")]
    )
    with ages.kept_on_disk(spark):
        rows = run.drain(ages.removals(reports, layers, "1 minute")).collect()
    # s2's timer moved from 30 to 45; f1 went 6 hours after its first report, came back and went again; f3 is still there.
    assert sorted((r.layer, r.id, r.t // 60, r.gone_at // 60) for r in rows) == [("fire", "f1", 1, 361), ("fire", "f1", 500, 860), ("fire", "f2", 101, 461), ("ship", "s1", 1, 21), ("ship", "s2", 25, 45), ("ship", "s3", 100, 120), ("ship", "s4", 500, 520), ("ship", "s5", 490, 510)]
    by = {(r.layer, r.id): r.batch for r in rows}
    assert by["ship", "s1"] < by["fire", "f2"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "unset") == "unset"
