"""One row repeated very often: dealt to several buckets, and once in a training sample."""

from pyspark.sql import functions as F

from sparkveil.llm import langid, quality, sharding


def test_equal_rows_are_dealt_to_buckets(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") >= 2000, F.repeat(F.lit("x"), 90)).alias("text"), F.lit("mine").alias("_spread"))
    rows = sharding.shard(docs, shards=3, bucket_bytes=2048, hot_rows=100).collect()
    assert len(rows) == 3000 and all(r._spread == "mine" for r in rows)
    hot = [r for r in rows if r.doc_id is None]
    assert len(hot) == 2000 and len({r.shard for r in hot}) == 1
    per = {b: sum(r.bucket == b for r in hot) for b in {r.bucket for r in hot}}
    assert len(per) > 5 and max(per.values()) <= 600
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_are_recomputed_by_the_law(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    h = lambda n: {r.doc_id: r.s for r in docs.select("doc_id", sharding.rendezvous(F.col("doc_id"), n).alias("s")).collect()}
    a, b = h(24), h(25)
    rows = {r.doc_id: r for r in sharding.shard(docs).collect()}
    assert all(rows[i].shard == a[i] and rows[i].grown_shard == b[i] for i in rows)
    assert all(b[i] in (a[i], 24) for i in rows)
    again = {r.doc_id: r.slot for r in sharding.shard(docs.repartition(7)).collect()}
    assert again == {i: r.slot for i, r in rows.items()}


def test_repeated_rows_come_once_into_samples(spark, monkeypatch):
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("immer der gleiche Satz").alias("text"), F.lit("de").alias("lang"))
    more = spark.createDataFrame([(2, "one more sentence", "en"), (3, "and yet another one", "en")], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "ftrl", lambda at, *rest, _f=langid.ftrl: (seen.append(len(at)), _f(at, *rest))[1])
    model = langid.train(rows.union(more), per_lang=5000)
    assert set(model.langs) == {"de", "en"} and seen and seen[0] <= 3
    monkeypatch.setattr(quality, "fit", lambda x, y, *rest, _f=quality.fit: (seen.append(len(y)), _f(x, y, *rest))[1])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    quality.train(rows.union(more).select("doc_id", "text"), labels)
    assert seen[-1] <= 3
