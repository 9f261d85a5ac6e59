"""Saved answers and files: exposed files, addresses of a domain, metadata of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t

#: Characters that two bodies are compared by, and the share of them that may differ.
COMPARED, DIFFERENT = 8192, 0.05
#: Placeholders that address patterns are made of.
PLACEHOLDERS = ("first", "last", "f", "l", "first_initial", "last_initial", "firstname", "lastname", "initials")
#: Keys of a PDF's information dictionary and what their values are.
PDF_KEYS = {"Author": "person", "Creator": "software", "Producer": "software", "CreationDate": "timestamp", "ModDate": "timestamp"}


def steady(body: Column, path: Column) -> Column:
    """The words of a body that don't change from answer to answer: none that holds the path asked for or a long number or token."""
    words = F.filter(F.split(F.lower(body), r"\s+"), lambda w: (w != "") & ~w.rlike("[0-9a-f]{16}|[0-9]{6}"))
    asked = F.lower(F.coalesce(path, F.lit("")))
    return F.array_join(F.filter(words, lambda w: (asked == "") | ~F.contains(w, asked)), " ")


def exposed_files(answers: DataFrame, controls: DataFrame) -> DataFrame:
    """Answers (host, path, status, body) that hold a file: 200 or 206, not empty, unlike each of the host's
    answers for paths that don't exist (``controls``: host, path, body; a few a host). Hosts without controls give none.

    Alike are bodies of equal steady words, and those of 80 characters or more whose edit distance over the first
    ``COMPARED`` characters is at most ``DIFFERENT`` of the longer one.
    """
    never = controls.select("host", steady(F.col("body"), F.col("path")).alias("_c")).distinct()
    asked = answers.where("status in (200, 206) and body <> ''").withColumn("_b", steady(F.col("body"), F.col("path")))
    b, c = F.substring("_b", 1, COMPARED), F.substring("_c", 1, COMPARED)
    longer = F.greatest(F.length(b), F.length(c))
    distance = F.levenshtein(b, c, int(COMPARED * DIFFERENT))  # -1 above it
    near = (F.least(F.length("_b"), F.length("_c")) >= 80) & (F.abs(F.length(b) - F.length(c)) <= longer * DIFFERENT) & (distance >= 0) & (distance <= longer * DIFFERENT)
    pairs = asked.join(never, "host").withColumn("_like", (F.col("_b") == F.col("_c")) | near)
    verdict = pairs.groupBy("host", "path").agg(F.max("_like").alias("_like"), F.max("status").alias("status"), F.max(F.length("body")).alias("size"))
    return verdict.where("not _like").drop("_like")


def address_forms(pages: DataFrame, key: str, html: str = "html", domain: str = "domain") -> DataFrame:
    """(key, kind, value, confidence): addresses at the page's domain, and patterns of known placeholders before it."""
    rows = pages.select(key, F.lower(t.strip_tags(F.col(html))).alias("_t"), F.lower(domain).alias("_d"))
    at = F.concat(F.lit("@"), "_d")
    plain = F.filter(F.regexp_extract_all("_t", F.lit(r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})"), F.lit(1)), lambda x: F.endswith(x, at))
    # A pattern is placeholders in braces, joined by . _ or -; letters may stand for one side.
    form = F.regexp_extract_all("_t", F.lit(r"((?:\{[a-z_]+\}|[a-z]+)[._-]?(?:\{[a-z_]+\}|[a-z]*)@)"), F.lit(1))
    known = F.filter(form, lambda x: x.rlike(r"\{[^@]*(?:" + "|".join(PLACEHOLDERS) + ")"))
    each = lambda kind, values: F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    both = F.concat(each("email", plain), each("email_pattern", F.transform(known, lambda x: F.concat(x, "_d"))))
    return rows.select(key, F.explode(both).alias("_e")).select(key, "_e.*", F.lit(0.6).alias("confidence"))


def document_metadata(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, field, kind, value) from the information dictionaries of PDF files, distinct: people, software and times.

    The bytes are read as Latin-1; strings in parentheses only (escaped parentheses stay inside), times as
    ``D:yyyyMMddHHmmss`` in UTC seconds. Files without the signature, and empty values, give nothing.
    """
    text = F.decode(F.col(content), "ISO-8859-1")

    def found(field: str, kind: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(rf"/{field}\s*\(((?:\\.|[^\\)])*)\)"), F.lit(1))
        return F.transform(hits, lambda v: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), v.alias("raw")))

    rows = files.where(F.substring(text, 1, 5) == "%PDF-").select(key, F.explode(F.concat(*[found(*x) for x in PDF_KEYS.items()])).alias("_e")).select(key, "_e.*")
    clean = F.trim(F.regexp_replace("raw", r"\\(.)", "$1"))
    when = F.unix_seconds(F.try_to_timestamp(F.regexp_extract("raw", r"^D:(\d{14})", 1), F.lit("yyyyMMddHHmmss"))).cast("string")
    return rows.select(key, "field", "kind", F.when(F.col("kind") == "timestamp", when).otherwise(clean).alias("value")).where("value <> ''").distinct()
