"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, edits, fingerprint, jaccard, langid, merkle, oracles, packing, quality, sharding, spelling, suffix, toxicity
from .common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts of all conversations as canonical turns; the model learns outside the held-out fold."""
    raw = chat.transcripts(table(spark, sf_dir, "conversations")).withColumn("held_out", held_out("conv_id"))
    done = chat.format_transcripts(raw, chat.train(raw.where("not held_out")))
    found = F.transform("turns", lambda t: t["role"])
    return done.select(
        "conv_id", "part", "held_out", F.size("roles").alias("n_turns"), F.size("turns").alias("n_found"),
        F.coalesce(found == F.col("roles"), F.lit(False)).alias("roles_right"), "rendered",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every whole text, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.withColumn("held_out", held_out()), trees).select("doc_id", "held_out", "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the ``key`` law, shuffled within each shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after edits that follow from each row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edits.counts(edits.sample_edits(docs)).select("doc_id", "n_tokens", "edited_tokens", "n_pretokens", "reencoded")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside benchmark windows of ten words."""
    found = decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word Jaccard similarity of 0.8 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that no repeated string of 400 bytes covers, and how many are in repeated passages of 250 bytes.

    A passage of just over 50 words has fewer than 400 bytes in most languages, so it stays; ``passage_bytes`` tells of it.
    """
    return suffix.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=suffix.PASSAGE).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"), "passage_bytes"
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.edited_and_next(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its (in part tampered) text leads to."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.lower_cased())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of the documents, some of which lose a character."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op2_sharding": op2_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_toxicity": op13_toxicity,
}

ORACLES: dict[str, str] = oracles.ORACLES
