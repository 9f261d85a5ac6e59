"""Streams over several batches: states that go, late rows, and rows of a batch in order."""

import os

import pytest
from pyspark.sql import functions as F

from sparkveil.streaming import run, tracks

DAY = 86_400
SCHEMA = "ts timestamp, seq long, id string, t long, lat double, lon double, alt double, heading double, speed double, name string"


@pytest.fixture
def stream(spark, tmp_path):
    def of(*batches):
        """One file, and so one batch, of (seq, id, day, name) each."""
        for i, rows in enumerate(batches):
            values = ", ".join(f"({seq}, '{id_}', {day}, {'null' if name is None else repr(name)})" for seq, id_, day, name in rows)
            spark.sql(
                f"""select timestamp_seconds(day * {DAY}) as ts, cast(seq as long) as seq, id, cast(day * {DAY} as long) as t, 1D as lat, cast(seq as double) as lon,
                cast(null as double) as alt, cast(null as double) as heading, cast(null as double) as speed, cast(name as string) as name
                from values {values} as v(seq, id, day, name)"""
            ).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
            (found,) = (tmp_path / f"part{i}").glob("part-*.parquet")
            (tmp_path / "in").mkdir(exist_ok=True)
            os.utime(found.rename(tmp_path / "in" / f"{i}.parquet"), (1_000_000 + i, 1_000_000 + i))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return of


def test_idle_track_goes_and_late_fix_is_dropped(stream):
    # Spark judges lateness by the watermark that the batch before had, so one batch lies between b's first and the late fix.
    fixes = stream([(1, "a", 10, "X")], [(2, "b", 110, "Y")], [(3, "b", 110.1, None)], [(4, "a", 11, "late")], [(5, "a", 111, None), (6, "b", 111, None)])
    rows = run.drain(tracks.latest_tracks(fixes), "update").collect()
    assert not any(r.name == "late" for r in rows)
    last = {r.id: r for r in sorted(rows, key=lambda r: r.batch)}
    assert (last["a"].t, last["a"].name) == (111 * DAY, None)  # begun anew
    assert (last["b"].t, last["b"].name) == (111 * DAY, "Y")  # still known


def test_older_fix_within_the_watermark_changes_nothing(stream):
    fixes = stream([(2, "a", 10.02, "new"), (1, "a", 10.0, "old")], [(3, "a", 10.01, "between")])
    rows = run.drain(tracks.latest_tracks(fixes), "update").collect()
    assert {r.name for r in rows} == {"new"}


def test_thinned_across_batches(stream):
    fixes = stream([(2, "a", 10.5, None), (1, "a", 10, None)], [(3, "a", 11, None), (4, "a", 11.5, None)], [(5, "b", 110, None)], [(6, "a", 111, None), (7, "a", 111.5, None)])
    assert sorted(r.seq for r in run.drain(tracks.thinned(fixes, DAY)).collect()) == [1, 3, 5, 6]


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    batches = lambda most: {r.batch: r.n for r in run.drain(run.stream_of(spark, str(tmp_path), "events", most)).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sum(batches(None).values()) == 30 and len(batches(None)) == 1
    assert sum(batches(1).values()) == 30 and len(batches(1)) == 3
