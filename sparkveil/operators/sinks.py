"""What leaves the engine: rows that can't be stored set apart, satellite features, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isolated(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, the others with the first broken rule as ``reason``), before anything is written.

    A rule that is null counts as broken. Faults that no row causes (a lost store, a missing table) aren't rules: they
    fail the job, and Spark runs the task again.
    """
    kept = [F.coalesce(rule, F.lit(False)) for rule in rules.values()]
    reason = F.coalesce(*[F.when(~rule, F.lit(name)) for name, rule in zip(rules, kept, strict=True)])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def satellite_features(sets: DataFrame) -> DataFrame:
    """GeoJSON features of satellites: no geometry (it follows from the elements), the elements as properties."""
    elements = F.struct("norad_id", "name", "epoch_year", "epoch_day", "inclination", "mean_motion", F.lit("space").alias("layer"))
    feature = F.struct(F.lit("Feature").alias("type"), F.concat(F.lit("space:"), "norad_id").alias("id"), F.lit(None).cast("string").alias("geometry"), elements.alias("properties"))
    return sets.select("norad_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def markdown(table: DataFrame, order: str) -> DataFrame:
    """One row ``text``: a small table (one row a feed or layer) as Markdown, ordered by a column; null cells are empty."""
    columns = table.columns
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))), lambda x: x["line"])
    return table.agg(F.array_join(F.concat(F.array(F.lit(head)), lines), "\n").alias("text"))


def write_report(table: DataFrame, order: str, path: str) -> None:
    """A report of a small table in two forms: ``json`` (one object a line) and ``markdown`` under ``path``."""
    table.orderBy(order).coalesce(1).write.mode("overwrite").json(f"{path}/json")
    markdown(table, order).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
