"""From raw documents to packed training sequences: five stages of corpus operators.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last one packed pieces.
``run`` writes each stage's output to shared storage and reads it back as the next one's input.
Extra columns of the documents go through; a null doc_id is a document of its own text.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import decontam, jaccard, packing, quality, suffix
from sparkveil.llm.common import drop_table, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(F.struct("*").alias("d"), F.col("text")), trees).where("predicted = 1").select("d.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each Jaccard component, the one with the least doc_id.

    Rows are told apart by doc_id and text, so that only linked rows go; of rows that repeat both, the one whose columns
    as JSON have the least digest stays. Texts without words link with nothing and all stay.
    """
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    keyed = keyed.withColumn("_bare", ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    found = jaccard.join(keyed.where("not _bare").select(F.col("_key").alias("doc_id"), "text"))
    ids = keyed.where("not _bare").select("_key", F.col("doc_id").cast("long").alias("_id"))
    order = F.struct(F.col("_id").isNull(), "_id", "_key")
    members = found.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(ids, "_key")
    least = members.groupBy("component_id").agg(F.min_by("_key", order).alias("_key")).select("_key")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = keyed.where("not _bare").join(least, "_key", "left_semi").select("_key", row.alias("row"))
    kept = kept.groupBy("_key").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row.*")
    return kept.unionByName(keyed.where("_bare").drop("_key", "_bare"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what repeated strings of ``suffix.PASSAGE`` bytes cover, so that passages of over 50 words go; n_chars follows.

    A character of which a repeated string covers a part goes whole.
    """

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([suffix.without_spans(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    inner = suffix.remove(docs.select(F.struct("*").alias("d"), F.col("doc_id"), F.col("text")), length=suffix.PASSAGE)
    new = F.when(F.col("n_removed") > 0, without(F.coalesce("d.text", F.lit("")), "removed_spans")).otherwise(F.col("d.text"))
    kept = inner.select("d", new.alias("t"), "n_removed")
    out = {"text": F.col("t"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("t").cast("long")).otherwise(F.col("d.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("t")}
    return kept.select(*[out[c].alias(c) if c in out else F.col(f"d.`{c}`") for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    inner = decontam.find(docs.select(F.struct("*").alias("d"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return inner.where("n_hit = 0").select("d.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the trees nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
