"""Helpers that the corpus operators share.

``materialize`` cuts lineage with a Parquet table in the shared folder named by
``spark.checkpoint.dir``; a folder of our own is set only where that setting is missing
(tests on one machine).
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_FOLDS = 5


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session; one of our own only where driver and tasks are one process."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder, and executors can't see this machine's temporary files")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that ``materialize`` returned; nothing may read it any more."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_ROWS = 2_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lets Arrow batches hold ``rows`` rows at most: whole texts are long, and a worker holds a batch several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id="doc_id"):
    """crc32 of the id's text, remainder 0 of 5; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS) == 0


# --- polynomial hashing over uint64 (wrapping arithmetic) -------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(B^i, B^-i) for i < n, modulo 2^64; grown by doubling and kept per process."""
    have = len(_POWERS.get("b", ()))
    if have < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, base in (("b", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = np.uint64(pow(base, done, 1 << 64))
                out[done : 2 * done] = out[:done] * step
                done *= 2
            _POWERS[key] = out
    return _POWERS["b"][:n], _POWERS["inv"][:n]


def symbol_table(seed: int, size: int = 256) -> np.ndarray:
    """Fixed pseudo-random 64-bit values for bytes."""
    return np.random.default_rng(seed).integers(0, 1 << 64, size, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """h[i] = sum of symbols[j] * B^j for j < i, so any slice's hash is a difference."""
    b, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * b[:-1], out=out[1:])
    return out


def slice_hash(h: np.ndarray, start, end) -> np.ndarray:
    """Hashes of the slices [start, end), the same wherever the slice lies."""
    _, inv = powers(len(h))
    return (h[end] - h[start]) * inv[start]


# --- connected components -----------------------------------------------------------------------


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node it reaches.

    Alternating large-star and small-star rounds; each round is two aggregations by node and
    its output goes to shared storage, so a lost executor costs one round at most. Hot nodes
    are combined map-side (min) before they are shuffled. Null ends are dropped.
    """
    e = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{label}-edges",
    )
    before = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least2, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        old, e = e, materialize(small, f"{label}-round")
        drop_table(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
