"""Operator 2, sharding: a two-pass external shuffle in DataFrame functions only.

Pass 1 scatters records into memory-sized buckets by seeded hashes of the record's key; pass 2
orders each bucket canonically, permutes it with ``shuffle(array, seed)`` (Spark's own seeded
Fisher-Yates) and lays the buckets of a shard one after another.

The shard of a record follows the ``key`` law: rendezvous hashing, so the key and the number of
shards decide, and one shard more takes rows only into itself.

Rows of one key and payload agree in every hash, so from ``HOT_ROWS`` of them on they are dealt to buckets
in portions of that many; within its portion such a row's place follows from its place in the input.

Cases: a null key hashes like the string "null-key"; null or empty payloads are ordinary records;
repeated rows are all kept and get slots of their own; an empty table gives an empty result;
columns of the input named like an output column are replaced by the output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

SEED = 20240229
BUCKET_BYTES = 4 << 20
HOT_ROWS = 10_000


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """Index of the shard with the greatest hash of (key, shard)."""
    k = F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null-key")))
    scored = [F.struct(F.xxhash64(k, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*scored)["s"] if shards > 1 else F.lit(0)


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", payload: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All records with ``size``, ``shard``, ``bucket``, ``slot`` and ``grown_shard``.

    Buckets hold ``bucket_bytes`` on average whatever the corpus weighs; their number follows
    from the summed sizes of all records.
    """
    out = ("size", "shard", "bucket", "slot", "grown_shard")
    docs = docs.select(*[c for c in docs.columns if c not in out])
    size = (F.coalesce(F.octet_length(payload), F.lit(0)) + 8).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    spread = F.xxhash64(F.lit(seed + 1), F.coalesce(F.col(key).cast("string"), F.lit("null-key")), F.coalesce(F.xxhash64(payload), F.lit(0)))
    spread_as = fresh(docs, "_spread")
    hot = materialize(docs.select(spread.alias(spread_as)).groupBy(spread_as).agg(F.count("*").alias("_hot_rows")).where(f"_hot_rows >= {hot_rows}"), "shard-hot")
    portion = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_hot_rows") / hot_rows).cast("long"))
    dealt = F.when(F.col("_hot_rows").isNull(), F.col(spread_as)).otherwise(F.xxhash64(spread_as, portion))
    placed = docs.select(
        "*",
        size.alias("size"),
        rendezvous(F.col(key), shards, seed).alias("shard"),
        rendezvous(F.col(key), shards + 1, seed).alias("grown_shard"),
        spread.alias(spread_as),
    ).join(hot, spread_as, "left").withColumn("bucket", F.col("shard") * F.lit(per_shard).cast("long") + F.pmod(dealt, F.lit(per_shard).cast("long"))).drop(spread_as, "_hot_rows")
    counts = placed.groupBy("shard", "bucket").count()
    ordered = counts.selectExpr("bucket", "sum(count) over (partition by shard order by bucket) - count as first_slot")
    record = F.struct(F.col(key).alias("_k"), F.xxhash64(payload).alias("_h"), *[F.col(c) for c in placed.columns if c != "bucket"])
    gathered = placed.select("bucket", record.alias("r")).groupBy("bucket").agg(F.array_sort(F.collect_list("r"), _by_key).alias("rs"))
    # shuffle() draws by partition and row: with rows in a fixed order a task that is run again draws the same
    mixed = gathered.join(ordered, "bucket").sortWithinPartitions("bucket").select(
        "bucket", "first_slot", F.expr(f"posexplode(shuffle(rs, {seed}))").alias("at", "r")
    )
    return mixed.select("r.*", "bucket", (F.col("first_slot") + F.col("at")).cast("long").alias("slot")).drop("_k", "_h")


def _by_key(a: Column, b: Column) -> Column:
    """Canonical order within a bucket, so that a seed always gives one permutation."""
    lt = lambda x, y: F.coalesce(x < y, x.isNull() & y.isNotNull())
    gt = lambda x, y: F.coalesce(x > y, x.isNotNull() & y.isNull())
    return (
        F.when(lt(a["_k"], b["_k"]), -1).when(gt(a["_k"], b["_k"]), 1)
        .when(lt(a["_h"], b["_h"]), -1).when(gt(a["_h"], b["_h"]), 1).otherwise(0)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Pass 2's output: one folder for each shard, one file for each of its buckets' tasks, in slot order."""
    sharded.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard").parquet(path)
