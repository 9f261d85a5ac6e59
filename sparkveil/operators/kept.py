"""State tables that are kept: batches change only the buckets of keys that they touch.

A table is a folder. Rows lie in buckets of their keys' hash; a batch writes the touched buckets anew under its own
number, then commits by writing which buckets it wrote. Readers take the newest committed files of each bucket, so they
see a batch whole or not at all, and go on with the files they started with. A batch that was committed is skipped
when it is repeated; one that broke off before is written over. The driver handles bucket numbers only.

``fold`` makes rows of old rows and new rows of the same columns; it must give the same for ``fold(fold(a) + b)``
as for ``fold(a + b)``, where b came later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import states

Fold = Callable[[DataFrame], DataFrame]


class KeptTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], fold: Fold, buckets: int = 64):
        self.spark, self.path, self.keys, self.fold, self.buckets = spark, path, keys, fold, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _at(self, *parts: str) -> str:
        return "/".join((self.path, *parts))

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._files(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._files(path)
        fs.delete(p, True)

    def _folders(self, path: str) -> list[int]:
        """The numbers in the names ``name=number`` below a folder."""
        fs, p = self._files(path)
        if not fs.exists(p):
            return []
        return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if "=" in s.getPath().getName()]

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def committed(self) -> dict[int, int]:
        """Bucket and the newest committed batch that wrote it."""
        if not self._folders(self._at("commits")):
            return {}
        rows = self.spark.read.schema("bucket int, batch long").parquet(self._at("commits")).groupBy("bucket").agg(F.max("batch").alias("batch"))
        return {r["bucket"]: r["batch"] for r in rows.collect()}  # a row a bucket at most

    def last_batch(self) -> int:
        return max(self._folders(self._at("commits")), default=-1)

    def current(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows of the newest version, or those of some buckets, of which only their files are read."""
        chosen = {k: v for k, v in self.committed().items() if buckets is None or k in buckets}
        have = {(n, k) for n in set(chosen.values()) for k in self._folders(self._at("data", f"batch={n}"))}
        paths = [self._at("data", f"batch={n}", f"bucket={k}") for k, n in sorted(chosen.items()) if (n, k) in have]  # a bucket may be empty
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Folds ``rows`` into the table as batch number ``batch``; numbers must rise. False if it was there already."""
        if batch <= self.last_batch():
            return False
        staged, data = self._at("staged", f"batch={batch}"), self._at("data", f"batch={batch}")
        names = self.schema.names
        numbered = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn("bucket", self.bucket())
        numbered.write.mode("overwrite").partitionBy("bucket").parquet(staged)  # the batch is worked out once
        touched = set(self._folders(staged))
        new = self.spark.read.schema(StructType([*self.schema.fields])).option("basePath", staged).parquet(staged).select(names) if touched else self.spark.createDataFrame([], self.schema)
        made = self.fold(self.current(touched).unionByName(new)).select(*names).withColumn("bucket", self.bucket())
        made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        done = self.spark.createDataFrame([(k,) for k in sorted(touched)], "bucket int")
        done.coalesce(1).write.mode("overwrite").parquet(self._at("commits", f"batch={batch}"))
        self._delete(staged)
        return True

    def vacuum(self) -> None:
        """Deletes the files that no reader of the newest version needs, and those of batches that broke off."""
        now = self.committed()
        for n in self._folders(self._at("data")):
            for k in self._folders(self._at("data", f"batch={n}")):
                if now.get(k) != n:
                    self._delete(self._at("data", f"batch={n}", f"bucket={k}"))


# --- folds ---------------------------------------------------------------------------------------

TRACK = "id string, seq long, t long, lat double, lon double, alt double, name string, heading double, speed double"


def tracks(rows: DataFrame) -> DataFrame:
    """The state of each track as a fix of its own: the newest accepted position, the last known name, heading and speed."""
    newest = F.max_by(F.struct("seq", "t", "lat", "lon", "alt"), "seq").alias("n")
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("name", "heading", "speed")]
    return states.record_setters(rows).groupBy("id").agg(newest, *known).select("id", "n.*", "name", "heading", "speed")


EVENT = "seq long, batch long, key string, layer string, t long, mag double, supersedes string"


def events(rows: DataFrame) -> DataFrame:
    """The last row of each (key, t)."""
    return states.last_per_key(rows, ["key", "t"], ["batch", "seq"])


HISTORY = "seq long, batch long, id string, t long, lat double, lon double, alt double, heading double, speed double, name string"


def history(rows: DataFrame) -> DataFrame:
    """The first row of each (id, t)."""
    return states.position_history(rows)


EDGE = "src long, dst long, rel string, module string, confidence double"


def edges(rows: DataFrame) -> DataFrame:
    """The highest confidence of each edge."""
    return states.edges(rows)


ENTITY = (
    "type string, value string, confidence double, first_seen long, last_seen long, observations long, "
    "located struct<t: long, seq: long, lat: double, lon: double>, meta map<string, struct<seq: long, v: string>>"
)


def entity_rows(emissions: DataFrame) -> DataFrame:
    """Every emission as an entity of one observation."""
    return emissions.select(
        "type", "value", "confidence", F.col("t").alias("first_seen"), F.col("t").alias("last_seen"), F.lit(1).cast("long").alias("observations"),
        F.when(F.col("lat").isNotNull(), F.struct("t", "seq", "lat", "lon")).alias("located"),
        F.when(F.col("meta_key").isNotNull(), F.create_map("meta_key", F.struct("seq", F.col("meta_value").alias("v")))).alias("meta"),
    )


def entities(rows: DataFrame) -> DataFrame:
    """Entities of the same type and value as one: the surest, first and last time, latest place, last value of each metadata key.

    Metadata is combined key by key, never gathered row by row.
    """
    base = rows.groupBy("type", "value").agg(
        F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("observations").alias("observations"), F.max("located").alias("located")
    )
    last = rows.select("type", "value", F.explode("meta").alias("k", "v")).groupBy("type", "value", "k").agg(F.max("v").alias("v"))
    meta = last.groupBy("type", "value").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
    b, m = base.alias("b"), meta.alias("m")
    same = F.col("b.type").eqNullSafe(F.col("m.type")) & F.col("b.value").eqNullSafe(F.col("m.value"))
    return b.join(m, same, "left").select("b.*", "m.meta")


def described(entities: DataFrame) -> DataFrame:
    """Kept entities with place and metadata as plain columns."""
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e["key"], e["value"]["v"]))), ";")
    return entities.select("type", "value", "confidence", "first_seen", "last_seen", "observations", "located.lat", "located.lon", meta.alias("meta"))
