"""Fusion of geolocation evidence, feed health over a journal, grouping and quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

STALE_DAYS = 45
#: Radius of each precision in kilometres, tightest first.
PRECISIONS = (("street", 0.15), ("city", 15.0), ("region", 150.0), ("country", 600.0))


def vote(claims: DataFrame, field: str) -> DataFrame:
    """One value of ``field`` per target by weighted vote: each vendor's newest claim weighs 1, or 0.5 if stale;
    a tie of the two best gives null; ``conflict`` tells that vendors differ."""
    newest = claims.where(F.col(field).isNotNull()).groupBy("target", "vendor").agg(F.min_by(F.struct(F.col(field).alias("v"), "age_days"), "age_days").alias("c"))
    weight = F.when(F.col("c.age_days") > STALE_DAYS, 0.5).otherwise(1.0)
    sums = newest.select("target", F.col("c.v").alias("v"), weight.alias("w")).groupBy("target", "v").agg(F.sum("w").alias("w"))
    ranked = sums.groupBy("target").agg(F.reverse(F.array_sort(F.collect_list(F.struct("w", "v")))).alias("r"))  # one entry per vendor at most
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    tie = F.coalesce(first["w"] == second["w"], F.lit(False))
    return ranked.select("target", F.when(~tie, first["v"]).alias(field), (F.size("r") > 1).alias(f"{field}_conflict"))


def fuse(claims: DataFrame) -> DataFrame:
    """Country and network votes, the chosen location (fresh, then tightest, then newest), how far the other
    claims lie from it, and a confidence that falls with disagreement."""
    stale = F.col("age_days") > STALE_DAYS
    best = claims.groupBy("target").agg(F.min_by(F.struct("vendor", "lat", "lon", "radius_km"), F.struct(stale, "radius_km", "age_days", "vendor")).alias("b"))
    apart = claims.join(best, "target").groupBy("target").agg(F.max(haversine_m("lat", "lon", "b.lat", "b.lon") / 1000).alias("apart_km"))
    out = best.join(apart, "target").join(vote(claims, "country"), "target", "left").join(vote(claims, "asn"), "target", "left")
    radius = F.greatest("b.radius_km", F.least("apart_km", F.lit(600.0)))
    precision = F.when(radius <= 15, "city").when(radius <= 150, "region").otherwise("country")
    return out.select(
        "target", F.col("b.vendor").alias("vendor"), "country", "asn", F.coalesce("country_conflict", F.lit(False)).alias("country_conflict"), F.coalesce("asn_conflict", F.lit(False)).alias("asn_conflict"),
        F.round("apart_km", 3).alias("apart_km"), precision.alias("precision"), F.when(F.coalesce("country_conflict", F.lit(False)), 0.7 * 0.6).otherwise(0.7).alias("confidence"),
    )


def halos(points: DataFrame) -> DataFrame:
    """Coarse features grouped by layer, precision and position rounded to 4 places; ``grouped`` is null for one."""
    n = F.count("*")
    return points.groupBy("layer", "precision", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).agg(F.min("seq").alias("seq"), F.when(n > 1, n).alias("grouped"))


def freshness(events: DataFrame, as_of: int) -> DataFrame:
    """Rows, newest time and rows of the last hour before ``as_of``, by layer."""
    return events.groupBy("layer").agg(F.count("*").alias("rows"), F.max("t").alias("newest"), F.count_if(F.col("t").between(as_of - 3600, as_of)).alias("last_hour"))


def quality_counts(emissions: DataFrame, as_of: int) -> DataFrame:
    """Counts of emissions that break a rule, by type."""
    return emissions.groupBy("type").agg(
        F.count("*").alias("rows"), F.count_if(F.col("lat").isNull()).alias("no_geo"), F.count_if(F.col("value").isNull()).alias("no_key"), F.count_if(F.col("t").isNull()).alias("no_time"),
        F.count_if(F.col("t") > as_of + 3600).alias("future"), F.count_if(F.abs("lat") > 89.9).alias("bad_lat"),
    )


def metric_summary(journal: DataFrame) -> DataFrame:
    """Least, greatest, first, last and mean value of the metric events of each module."""
    m = journal.where("kind = 'metric' and value is not null")
    return m.groupBy("module").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.min_by("value", F.struct("t", "seq")).alias("first"), F.max_by("value", F.struct("t", "seq")).alias("last"), F.round(F.avg("value"), 6).alias("mean"))


#: Seconds of a time slice of ordered scans: rows are scanned within their slice, and what goes on from slice to slice by a row a slice.
SLICE_S = 3600


def _slices(rows: DataFrame, slice_s: int, **carried: Column) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``_slice``, and a row for each module and slice with what it ``carried``)."""
    cut = rows.withColumn("_slice", F.floor(F.col("t") / slice_s))
    return cut, cut.groupBy("module", "_slice").agg(*[c.alias(name) for name, c in carried.items()])


def _of_slice(cut: DataFrame, slices: DataFrame) -> DataFrame:
    """``cut`` with its slices' columns; null modules meet."""
    a, b = cut.alias("a"), slices.alias("b")
    same = F.col("a.module").eqNullSafe(F.col("b.module")) & (F.col("a._slice") == F.col("b._slice"))
    return a.join(b, same).select("a.*", *[F.col(f"b.{c}") for c in slices.columns if c not in ("module", "_slice")])


_WITHIN, _ACROSS = "over (partition by module, _slice order by t, seq", "over (partition by module order by _slice"


def segments(journal: DataFrame, starts: str, slice_s: int = SLICE_S) -> DataFrame:
    """Journal events with the number of the process run they belong to, by module."""
    marked = journal.withColumn("_start", F.expr(f"if({starts}, 1, 0)"))
    cut, slices = _slices(marked, slice_s, _starts=F.sum("_start"))
    before = slices.selectExpr("module", "_slice", f"sum(_starts) {_ACROSS}) - _starts as _before")
    run = F.expr(f"_before + sum(_start) {_WITHIN} rows between unbounded preceding and current row)")
    return _of_slice(cut, before).withColumn("segment", run).select(*journal.columns, "segment")


def trends(rows: DataFrame, warm_up_s: int = 900, least: int = 3) -> DataFrame:
    """Slope per hour of ``value`` over time in each module's longest segment, after its warm-up."""
    first = rows.groupBy("module", "segment").agg(F.min("t").alias("t0"))
    warm = rows.join(first, ["module", "segment"]).where((F.col("t") - F.col("t0") >= warm_up_s) & F.col("value").isNotNull())
    hours = (F.col("t") - F.col("t0")) / 3600.0
    fits = warm.groupBy("module", "segment").agg(F.regr_slope("value", hours).alias("slope"), F.count("*").alias("points"), (F.max("t") - F.min("t")).alias("span")).where(F.col("points") >= least)
    return fits.groupBy("module").agg(F.max_by(F.struct("segment", "slope", "points", "span"), F.struct("span", "segment")).alias("f")).select("module", "f.*")


def normalised(message: str = "message"):
    """A message with its varying parts masked, so that equal failures group."""
    rules = ((r"0x[0-9a-f]+", "<hex>"), (r"\b\d+\.\d+\b", "<num>"), (r"\d+", "<n>"))
    out = F.col(message)
    for pattern, mask in rules:
        out = F.regexp_replace(out, pattern, mask)
    return out


def error_groups(journal: DataFrame, most: int = 400, parts: int = 32) -> DataFrame:
    """Errors by module and normalised message; groups beyond ``most``, by count, share one overflow row.

    Groups are ranked in parts first: what isn't among the first of its part isn't among the first of all.
    """
    groups = journal.where("kind = 'poll.error'").groupBy("module", normalised().alias("message")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "message"))
    dealt = groups.withColumn("_part", F.pmod(F.xxhash64("message"), F.lit(parts))).withColumn("_first", rank("module", "_part") <= most)
    ranked = dealt.where("_first").withColumn("place", rank("module"))
    label = F.when(F.col("place") <= most, F.col("message")).otherwise(F.lit("(other)"))
    columns = ["module", "message", "n", "first_t", "last_t"]
    both = ranked.withColumn("message", label).select(columns).unionByName(dealt.where("not _first").withColumn("message", F.lit("(other)")).select(columns))
    return both.groupBy("module", "message").agg(F.sum("n").alias("n"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))


def scorecard(journal: DataFrame) -> DataFrame:
    """Attempts, failures, success share and verdict of each feed."""
    ok, bad = F.count_if(F.col("kind") == "poll.ok"), F.count_if(F.col("kind") == "poll.error")
    base = journal.groupBy("module").agg(ok.alias("ok"), bad.alias("failed"), F.sum(F.when(F.col("kind") == "sink.stats", F.col("rows")).otherwise(0)).alias("stored"))
    share = F.round(100.0 * F.col("ok") / (F.col("ok") + F.col("failed")), 2)
    verdict = F.when(F.col("ok") + F.col("failed") == 0, "NOT DUE").when(F.col("ok") == 0, "FAIL").when(share < 50, "WARN").otherwise("PASS")
    return base.select("module", "ok", "failed", "stored", share.alias("share"), verdict.alias("verdict"))


def longest_gaps(journal: DataFrame, end: int, slice_s: int = SLICE_S) -> DataFrame:
    """The longest time between successes of each feed, the open one up to ``end`` included."""
    good = journal.where("kind = 'poll.ok' and t is not null").select("module", "t", "seq")
    cut, slices = _slices(good, slice_s, first=F.min("t"), last=F.max("t"))
    inside = cut.selectExpr("module", "t", f"t - lag(t) {_WITHIN}) as gap")
    between = slices.selectExpr("module", "first as t", f"first - lag(last) {_ACROSS}) as gap")
    open_ = slices.groupBy("module").agg(F.lit(end).cast("long").alias("t"), (F.lit(end) - F.max("last")).alias("gap"))
    gaps = inside.union(between).union(open_.select("module", "t", "gap")).where("gap is not null")
    return gaps.groupBy("module").agg(F.max("gap").alias("gap"), F.max_by("t", F.struct("gap", F.col("t") * -1)).alias("until"))


def stalls(journal: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """Errors with the time of the next success of their feed; null while the stall is open."""
    ok = F.when(F.col("kind") == "poll.ok", F.col("t"))
    cut, slices = _slices(journal.where("kind in ('poll.ok', 'poll.error')"), slice_s, ok=F.min(ok))
    later = slices.selectExpr("module", "_slice", f"min(ok) {_ACROSS} rows between 1 following and unbounded following) as _later")
    soon = F.expr(f"min(if(kind = 'poll.ok', t, null)) {_WITHIN} rows between 1 following and unbounded following)")
    marked = _of_slice(cut, later).withColumn("recovered", F.coalesce(soon, "_later"))
    return marked.where("kind = 'poll.error'").select("module", "seq", "t", "recovered")


def timeline(journal: DataFrame, head: int, tail: int, slice_s: int = SLICE_S) -> DataFrame:
    """The first ``head`` and last ``tail`` events of each module."""
    cut, slices = _slices(journal, slice_s, _n=F.count("*"))
    placed = slices.selectExpr("module", "_slice", "_n", f"sum(_n) {_ACROSS}) - _n as _before", "sum(_n) over (partition by module) as _all").where(f"_before < {head} or _all - _before - _n < {tail}")
    numbered = _of_slice(cut, placed).withColumn("_at", F.expr(f"_before + row_number() {_WITHIN})"))
    return numbered.where((F.col("_at") <= head) | (F.col("_at") > F.col("_all") - tail)).select(*journal.columns)


def tile_density(points: DataFrame, step: float = 5.0) -> DataFrame:
    """Features and tier (hot, warm, cold) of every tile of a regular grid."""
    rows, columns = int(180 / step), int(360 / step)
    spark = points.sparkSession
    grid = spark.range(rows * columns).selectExpr(f"cast(id div {columns} as int) as y", f"cast(id % {columns} as int) as x")
    y = F.least(F.lit(rows - 1), F.floor((F.col("lat") + 90) / step)).cast("int")
    x = F.least(F.lit(columns - 1), F.floor((F.col("lon") + 180) / step)).cast("int")
    counts = points.groupBy(y.alias("y"), x.alias("x")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, ["y", "x"], "left").select("y", "x", n.alias("features"), F.when(n >= 10, "hot").when(n >= 1, "warm").otherwise("cold").alias("tier"))


def deltas(samples: DataFrame, group: str, value: str) -> DataFrame:
    """First and last value of each group by time, and their difference."""
    order = F.struct("t", "seq")
    ends = samples.groupBy(group).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return ends.withColumn("delta", F.col("last") - F.col("first"))


def quota(journal: DataFrame, most: int = 20) -> DataFrame:
    """Events per module, kind and hour: total, kept in full (the first ``most``) and suppressed."""
    hours = journal.groupBy("module", "kind", (F.floor(F.col("t") / 3600) * 3600).alias("hour")).agg(F.count("*").alias("total"), F.max("t").alias("last_t"))
    return hours.withColumn("journaled", F.least("total", F.lit(most).cast("long"))).withColumn("suppressed", F.col("total") - F.col("journaled"))


def sessions(events: DataFrame, key: str, silence_s: int) -> DataFrame:
    """Runs of events of a key without a silence longer than ``silence_s``."""
    order = Window.partitionBy(key).orderBy("t", "seq")
    opened = events.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(order) > silence_s, F.lit(True)).cast("int"))
    numbered = opened.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session").agg(F.min("t").alias("opened"), F.max("t").alias("closed"), F.count("*").alias("events"))


def sliding_freshness(events: DataFrame, width_s: int, step_s: int) -> DataFrame:
    """Events by layer in every window of ``width_s`` that starts at a multiple of ``step_s``."""
    starts = F.sequence(F.floor((F.col("t") - width_s) / step_s).cast("long") + 1, F.floor(F.col("t") / step_s).cast("long"))
    return events.select("layer", F.explode(starts).alias("k")).groupBy("layer", (F.col("k") * step_s).alias("start")).agg(F.count("*").alias("events"))
