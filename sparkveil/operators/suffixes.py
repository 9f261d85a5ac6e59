"""Public suffixes by a table of rules: plain ones, wildcards and exceptions.

A rule is text as published: ``co.uk``, ``*.ck`` (any one label before ``ck``), ``!www.ck`` (no suffix in spite of the
wildcard). Every label suffix of a host is looked up among the rules, an equal join; an exception wins, then the rule
with the most labels. Hosts are looked up once each, so a host that stands in a third of all rows costs one lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed_rules(lines: DataFrame, line: str = "rule") -> DataFrame:
    """(key, kind, labels) of published rules; comments, blank lines and what follows a blank are left out.

    ``labels`` is the number of labels of the suffix that the rule makes.
    """
    text = F.lower(F.regexp_extract(F.trim(line), r"^(\S*)", 1))
    rows = lines.select(text.alias("t")).where("t <> '' and not startswith(t, '//')").distinct()
    kind = F.when(F.startswith("t", F.lit("!")), "exception").when(F.startswith("t", F.lit("*.")), "wildcard").otherwise("plain")
    key = F.regexp_replace("t", r"^(?:!|\*\.)", "")
    n = F.size(F.split(key, r"\."))
    labels = F.when(kind == "exception", n - 1).when(kind == "wildcard", n + 1).otherwise(n)
    return rows.select(key.alias("key"), kind.alias("kind"), labels.alias("labels"))


def split_hosts(hosts: DataFrame, rules: DataFrame, host: str = "host", unlisted: bool = True) -> DataFrame:
    """(host, suffix, registrable) of the distinct hosts of ``hosts``.

    Hosts are compared lower-cased and without a last dot. ``registrable`` is the suffix and one label more, null where
    the host is a suffix itself. Where no rule fits, the last label is the suffix (``unlisted``) or there is none. A
    host with an empty label has neither. Null hosts are left out.
    """
    plain = F.regexp_replace(F.lower(F.col(host)), r"\.$", "")
    one = hosts.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), plain.alias("h")).distinct().withColumn("l", F.split("h", r"\."))
    whole = one.where(~F.col("h").rlike(r"^\.|\.\.|^$"))
    ends = whole.select("host", "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("n"))
    keyed = ends.withColumn("key", F.array_join(F.slice("l", -F.col("n"), F.col("n")), "."))
    hits = keyed.join(rules, "key").where("labels <= size(l)")
    best = hits.groupBy("host").agg(F.max_by("labels", F.struct((F.col("kind") == "exception").cast("int").alias("e"), "labels")).alias("labels"))
    told = one.join(best, "host", "left").withColumn("k", F.when(F.col("h").rlike(r"^\.|\.\.|^$"), None).otherwise(F.coalesce("labels", F.lit(1) if unlisted else F.lit(None).cast("int"))))
    last = lambda n: F.array_join(F.slice("l", -n, n), ".")
    return told.select("host", F.when(F.col("k") > 0, last(F.col("k"))).alias("suffix"), F.when((F.col("k") > 0) & (F.size("l") > F.col("k")), last(F.col("k") + 1)).alias("registrable"))


def with_registrable(df: DataFrame, rules: DataFrame, host: str = "host", unlisted: bool = True) -> DataFrame:
    """``df`` with suffix and registrable of its hosts; rows without a host keep nulls and aren't shuffled by it."""
    found = split_hosts(df, rules, host, unlisted).withColumnRenamed("host", host)
    some = df.where(F.col(host).isNotNull()).join(found, host).select(*df.columns, "suffix", "registrable")
    none = df.where(F.col(host).isNull()).withColumns({c: F.lit(None).cast("string") for c in ("suffix", "registrable")})
    return some.unionByName(none)
