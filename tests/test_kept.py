"""Kept tables: batches against one recomputation, repeated and broken batches, untouched files, readers while a batch is written."""

import pathlib
import random

import pytest

from sparkveil.operators import kept, states


def files(path, bucket=None):
    return {str(p.relative_to(path)) for p in pathlib.Path(path).glob(f"data/*/bucket={'*' if bucket is None else bucket}/*.parquet")}


def fixes(spark, n, seed, first=0):
    r = random.Random(seed)
    maybe = lambda x: None if r.random() < 0.3 else x
    rows = [(f"id{r.randint(0, 8)}", first + i, r.randint(0, 50), r.random(), r.random(), maybe(1.0 * i), maybe(f"n{i}"), maybe(2.0 * i), maybe(3.0 * i)) for i in range(n)]
    return spark.createDataFrame(rows, kept.TRACK)


def plain(df):
    return sorted(map(str, df.collect()))


def test_tracks_like_one_recomputation(spark, tmp_path):
    table = kept.KeptTable(spark, f"file://{tmp_path}/t", kept.TRACK, ["id"], kept.tracks, 4)
    assert table.current().count() == 0
    batches = [fixes(spark, 40, n, 40 * n) for n in range(4)]
    whole = None
    for n, rows in enumerate(batches):
        assert table.upsert(rows, n)
        whole = rows if whole is None else whole.union(rows)
        assert plain(table.current().drop("seq")) == plain(states.track_state(whole).select("id", "t", "lat", "lon", "alt", "name", "heading", "speed"))
    before = files(tmp_path / "t")
    assert not table.upsert(batches[3], 3) and not table.upsert(batches[0], 0) and files(tmp_path / "t") == before


def test_only_touched_buckets_change(spark, tmp_path):
    table = kept.KeptTable(spark, f"file://{tmp_path}/t", kept.EDGE, ["src", "dst", "rel", "module"], kept.edges, 8)
    table.upsert(spark.range(200).selectExpr("id as src", "id as dst", "'r' as rel", "'m' as module", "0.5D as confidence"), 0)
    first = {k: files(tmp_path / "t", k) for k in range(8)}
    reader = table.current()
    table.upsert(spark.createDataFrame([(1, 1, "r", "m", 0.9), (1, 1, "r", "m", 0.1)], kept.EDGE), 1)
    now = table.committed()
    touched = {k for k, n in now.items() if n == 1}
    assert len(touched) == 1 and all(n == 0 for k, n in now.items() if k not in touched) and all(files(tmp_path / "t", k) == first[k] for k in range(8) if k not in touched)
    assert {r.confidence for r in reader.where("src = 1").collect()} == {0.5} and reader.count() == 200  # reads on what it began with
    assert {r.confidence for r in table.current().where("src = 1").collect()} == {0.9} and table.current().count() == 200
    assert table.current(touched).count() < 200
    table.vacuum()
    assert table.current().count() == 200 and all(len([f for f in files(tmp_path / "t", k)]) >= 1 for k in now) and not [f for f in files(tmp_path / "t", next(iter(touched))) if f.startswith("data/batch=0/")]


def test_broken_batch_is_unseen_and_written_over(spark, tmp_path):
    table = kept.KeptTable(spark, f"file://{tmp_path}/t", kept.EDGE, ["src", "dst", "rel", "module"], kept.edges, 4)
    edge = lambda c: spark.createDataFrame([(1, 2, "r", "m", c)], kept.EDGE)
    table.upsert(edge(0.1), 0)
    broken = kept.KeptTable(spark, table.path, kept.EDGE, table.keys, lambda rows: rows.selectExpr("src", "dst", "rel", "module", "raise_error('lost') as confidence"), 4)
    with pytest.raises(Exception, match="lost"):
        broken.upsert(edge(0.7), 1)
    assert [r.confidence for r in table.current().collect()] == [0.1] and table.last_batch() == 0
    assert table.upsert(edge(0.4), 1) and [r.confidence for r in table.current().collect()] == [0.4]


def test_empty_batches_and_null_keys(spark, tmp_path):
    table = kept.KeptTable(spark, f"file://{tmp_path}/t", kept.ENTITY, ["type", "value"], kept.entities, 4)
    rows = spark.createDataFrame([(1, "ip", None, 0.5, 10, None, None, "k", "a"), (2, "ip", None, 0.9, 5, 1.0, 2.0, "k", "b"), (3, None, "x", 0.1, 7, None, None, None, None)], "seq long, type string, value string, confidence double, t long, lat double, lon double, meta_key string, meta_value string")
    assert table.upsert(kept.entity_rows(rows.where("false")), 0) and table.current().count() == 0
    table.upsert(kept.entity_rows(rows.where("seq <> 2")), 1)
    table.upsert(kept.entity_rows(rows.where("seq = 2")), 2)
    assert sorted(map(tuple, kept.described(table.current()).collect()), key=str) == sorted([("ip", None, 0.9, 5, 10, 2, 1.0, 2.0, "k=b"), (None, "x", 0.1, 7, 7, 1, None, None, None)], key=str)
