"""A kept search index: documents, and postings of their letter groups, in two kept tables.

Documents (id, type, layer, value, label, aliases, degree, seen, ...) lie in buckets of their id, postings in buckets of
their group of one to three letters. A batch brings documents and deletions; it rewrites the buckets of its documents and
of the groups that they have or had. A search reads the buckets of its queries' groups, takes the documents under each
query's rarest group, a group that every hit must have, and tests only these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kept import KeptTable

DOCUMENT = "id long, type string, layer string, value string, label string, aliases array<string>, degree long, seen long, batch long, gone boolean"
POSTING = "gram string, id long, batch long, gone boolean"


def _newest(keys: list[str]):
    """The newest version of each key, unless that is a deletion."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        # of one batch's versions that which stays wins
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", ~F.col("gone"))).alias("r"))
        return best.select(*keys, "r.*").where("not gone").select(*rows.columns)

    return fold


def texts(df: DataFrame) -> DataFrame:
    """(id, text): the lower-cased value, label and aliases of documents."""
    all_ = F.concat(F.array("value", "label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return df.select("id", F.explode(F.array_distinct(F.filter(F.transform(all_, F.lower), lambda x: x.isNotNull() & (x != "")))).alias("text"))


def _groups(text: Column, sizes: tuple[int, ...]) -> Column:
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.filter(F.flatten(F.array(*map(of, sizes))), lambda g: g != ""))


def postings(df: DataFrame) -> DataFrame:
    """(id, gram): the distinct groups of one to three letters of each document."""
    return texts(df).select("id", F.explode(_groups(F.col("text"), (1, 2, 3))).alias("gram")).distinct()


def asked_groups(queries: DataFrame) -> DataFrame:
    """(qid, gram) of query texts: all their groups of three letters, or the whole of a shorter one."""
    q = F.lower(F.trim("q"))
    return queries.select("qid", q.alias("q")).where("q <> ''").select("qid", F.explode(F.when(F.char_length("q") >= 3, _groups(F.col("q"), (3,)).cast("array<string>")).otherwise(F.array("q"))).alias("gram")).where("char_length(gram) <= 3").distinct()


class KeptIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark = spark
        self.documents = KeptTable(spark, f"{path}/documents", DOCUMENT, ["id"], _newest(["id"]), buckets)
        self.postings = KeptTable(spark, f"{path}/postings", POSTING, ["gram", "id"], _newest(["gram", "id"]), buckets)
        self.postings.bucket = lambda: F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")

    def add(self, documents: DataFrame, batch: int, deleted: DataFrame | None = None) -> None:
        """Takes in new or changed ``documents`` and forgets those of ``deleted`` (id), as batch number ``batch``.

        Of several rows of an id one is taken; an id that is both deleted and brought stays. Postings come first, so
        that a batch that breaks off between the two tables is finished by repeating it.
        """
        columns = [f.split()[0] for f in DOCUMENT.split(", ")[:-2]]
        new = documents.select(*columns).dropDuplicates(["id"]).withColumn("batch", F.lit(batch).cast("long")).withColumn("gone", F.lit(False))
        away = (documents.select("id") if deleted is None else documents.select("id").union(deleted.select("id"))).where("id is not null").distinct()
        old = self.documents.current(self._buckets(self.documents, away)).join(away, "id", "left_semi")
        stamped = lambda df, gone: df.select("gram", "id", F.lit(batch).cast("long").alias("batch"), F.lit(gone).alias("gone"))
        self.postings.upsert(stamped(postings(old), True).unionByName(stamped(postings(new), False)), batch)
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.documents.schema.fields[1:-2]]
        gone = away.select("id", *rest, F.lit(batch).cast("long").alias("batch"), F.lit(True).alias("gone"))
        self.documents.upsert(new.unionByName(gone), batch)

    @staticmethod
    def _buckets(table: KeptTable, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(table.bucket()).distinct().collect()}  # bucket numbers only

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(qid, id): documents under the rarest group of each query."""
        grams = asked_groups(queries)
        read = self.postings.current(self._buckets(self.postings, grams))
        counts = read.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        rarest = grams.join(counts, "gram", "left").groupBy("qid").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        return rarest.join(read, "gram").select("qid", "id")

    def search(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """(qid, id, score, place): equal 1.0, beginning 0.8, inside 0.5, in any of a document's texts; ties by degree and time, newest first, then id.

        ``queries`` has qid, q, types and layers; arrays that aren't null and not empty let only these in.
        """
        asked = queries.select("qid", F.lower(F.trim("q")).alias("q"), "types", "layers")
        # equal texts are tested once, equal searches ranked once
        texts = asked.select(F.col("q").alias("qid"), "q").where("q is not null").distinct()
        forms = asked.select("q", "types", "layers").distinct()
        docs = self.documents.current()
        hits = self.candidates(texts).withColumnRenamed("qid", "q").join(docs, "id")
        one_of = lambda c, a: (F.coalesce(F.size(a), F.lit(0)) <= 0) | F.coalesce(F.array_contains(a, F.col(c)), F.lit(False))
        all_ = F.transform(F.concat(F.array("value", "label"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower)
        any_ = lambda test: F.coalesce(F.exists(all_, lambda x: F.coalesce(test(x, F.col("q")), F.lit(False))), F.lit(False))
        score = F.when(any_(lambda x, q: x == q), 1.0).when(any_(F.startswith), 0.8).when(any_(F.contains), 0.5)
        scored = hits.withColumn("score", score).where("score is not null").select("q", "id", "type", "layer", "degree", "seen", "score")
        allowed = scored.join(forms, "q").where(one_of("type", "types") & one_of("layer", "layers"))
        order = Window.partitionBy("q", "types", "layers").orderBy(F.desc("score"), F.desc_nulls_last("degree"), F.desc_nulls_last("seen"), "id")
        placed = allowed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
        placed = placed.select(F.col("q").alias("_q"), F.col("types").alias("_types"), F.col("layers").alias("_layers"), "id", "score", "place")
        same = [F.col("q") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("types", "layers")]]
        return asked.join(placed, same).select("qid", "id", "score", "place")
