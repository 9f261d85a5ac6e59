"""Rows dealt to a fixed number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_by(df: DataFrame, *keys: str, least: int = 96) -> DataFrame:
    """``df`` in as many parts by ``keys`` as the session shuffles to, ``least`` at least.

    Adaptive execution joins parts by their compressed bytes, and derived rows compress well: a few MB may be millions of
    rows in one task's sort. Parts of a given number stay as they are.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least), *keys)


def met_in_parts(left: DataFrame, right: DataFrame, on: str, by: str, right_by: str, parts: int = 32, block: int = 1000) -> DataFrame:
    """``left`` joined with ``right`` on ``on``, where few keys have very many rows on both sides.

    The rows of a key of ``left`` are dealt out to ``parts`` parts by ``by``. Those of ``right``, the smaller one, go to
    all parts of their key as blocks of about ``block`` rows, so that no pairs of a key are one task's alone and a
    task holds little. The join is by merging, as a broadcast would hold the copies of all parts.
    """
    counts = right.groupBy(on).agg(F.ceil(F.count("*") / block).alias("_n"))
    numbered = right.join(counts, on).withColumn("_at", F.pmod(F.xxhash64(right_by), F.col("_n")))
    rest = [c for c in right.columns if c != on]
    blocks = numbered.groupBy(on, "_at").agg(F.collect_list(F.struct(*rest)).alias("_rows")).drop("_at").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    met = dealt_by(dealt, on, "_part").join(dealt_by(blocks, on, "_part").hint("merge"), [on, "_part"])
    return met.withColumn("_row", F.explode("_rows")).select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in rest])
