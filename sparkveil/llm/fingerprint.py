"""Operator 10, document fingerprints: one-permutation MinHash in DataFrame functions only.

Every five-word shingle is hashed once. The hash's top bits choose one of ``BINS`` bins, which
keeps its least hash. An empty bin copies a filled bin found along its own fixed sequence of
hashed probes (optimal densification), so equal sets stay equal and unlike sets don't share
the same donors by position. Each bin then stores the ``BITS`` low bits of its value, two hex
digits a bin; ``likeness`` corrects the share of equal bins for chance agreement.

Cases: a null text counts as the empty one, whose fingerprint is '' (alike to another empty
text with 1.0, to any other text with 0.0); a text of one to four words is one shingle; equal
texts have equal fingerprints; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 128
BITS = 8
WORDS = 5
PROBES = 8
_SHIFT = 56  # of 63 bits: seven for the bin
LEAST = -(1 << 63)


def shingle_hashes(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """Adds ``out``: the non-negative 63-bit hashes of the text's shingles, in text order."""
    hashed = df.withColumn("_w", F.transform(F.filter(F.split(F.lower(F.col(text)), "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    several = F.transform(
        F.sequence(F.lit(0), F.size("_w") - words),
        lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(words)]).bitwiseAND(F.lit((1 << 63) - 1)),
    )
    one = F.array(F.xxhash64("_w").bitwiseAND(F.lit((1 << 63) - 1)))
    none = F.array().cast("array<bigint>")
    return hashed.withColumn(out, F.when(F.size("_w") >= words, several).when(F.size("_w") > 0, one).otherwise(none)).drop("_w")


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: BINS small integers, or an empty array for a text without words."""
    hashed = shingle_hashes(df, text, "_h").withColumn("_s", F.sort_array("_h")).drop("_h")
    first = hashed.withColumn(
        "_m", F.filter("_s", lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get("_s", i - 1), _SHIFT)))
    ).drop("_s")
    placed = first.withColumn("_p", F.transform("_m", lambda x: F.shiftright(x, _SHIFT)))
    full = placed.withColumn(
        "_f", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get("_m", F.array_position("_p", j.cast("bigint")).cast("int") - 1))
    )

    def probe(j: Column) -> Column:
        """The value of the first filled bin on bin j's probe sequence."""
        seek = lambda at: lambda found, t: F.coalesce(found, F.get("_f", at(t).bitwiseAND(F.lit(BINS - 1)).cast("int")))
        none = F.lit(None).cast("bigint")
        short = F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), none, seek(lambda t: F.xxhash64(j, t)))
        start, stride = F.xxhash64(j, F.lit(0)), F.xxhash64(F.lit(0), j).bitwiseOR(F.lit(1))
        cycle = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), none, seek(lambda t: start.bitwiseAND(F.lit(0xFFFF)) + t * stride.bitwiseAND(F.lit(0xFFFF))))
        return F.coalesce(short, cycle)

    dense = F.transform("_f", lambda x, j: F.coalesce(x, probe(j)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    return full.withColumn(out, F.when(F.size("_m") > 0, dense).otherwise(F.array().cast("array<int>"))).drop("_m", "_p", "_f")


def packed(bins: str) -> Column:
    """The bins as lower-case hex, BITS / 4 digits each."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Jaccard estimate: (share of equal bins - 2^-BITS) / (1 - 2^-BITS), held to 0..1."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    corrected = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance)))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(corrected)
    )


def with_next(df: DataFrame, key: str, columns: list[str], tie: str, rows_per_range: int = 2000) -> DataFrame:
    """Adds next_<column> of the row that follows in ascending ``key``; the first follows the last.

    Rows go to ranges of the key whose bounds are existing keys; a row that opens a range is
    also sent to the range before it, and the very first to the last range, so that each range
    finds its successors alone. A null key stands before all others; equal keys follow in order
    of ``tie`` (a 64-bit hash).
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(LEAST))
    seen = df.select(k.alias("k")).agg(F.count("*").alias("n"), F.min("k").alias("least"))
    n, least = seen.first()
    ranges = max(1, min(4096, n // rows_per_range))
    probs = [i / ranges for i in range(1, ranges)]
    bounds = [least if least is not None else LEAST]
    if probs:
        cut = df.select(k.alias("k")).agg(F.percentile_approx("k", probs, max(10_000, 20 * ranges))).first()[0]
        bounds = sorted({*bounds, *cut})
    at = F.greatest(F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("_k"))) - 1, F.lit(0))
    last = len(bounds) - 1
    opens = F.col("_k") == F.get(F.lit(bounds), F.col("_at"))
    homes = F.array_compact(
        F.array(
            F.struct(F.col("_at").alias("home"), F.lit(0).alias("guest")),
            F.when(opens & (F.col("_at") > 0), F.struct((F.col("_at") - 1).alias("home"), F.lit(1).alias("guest"))),
            F.when(F.col("_k") == bounds[0], F.struct(F.lit(last).alias("home"), F.lit(2).alias("guest"))),
        )
    )
    spread = df.withColumn("_k", k).withColumn("_at", at).withColumn("_to", F.explode(homes))
    window = "over (partition by _to.home order by _to.guest, _k, " + tie + ")"
    return (
        spread.selectExpr(*df.columns, "_to", *[f"lead({c}) {window} as next_{c}" for c in columns])
        .where("_to.guest = 0")
        .drop("_to")
    )


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``fingerprint`` of one text column."""
    plain = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return with_bins(plain, "_text", "_bins").withColumn("fingerprint", packed("_bins")).drop("_bins", "_text")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness; see the contract of op10."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("tie", F.xxhash64("t"))
    ready = with_bins(base, "t", "bins")
    paired = with_next(ready, "doc_id", ["t", "bins"], "tie")
    half = F.floor(F.char_length("t") / 2).cast("int")
    edited = paired.withColumn("n_chars", F.char_length("t").cast("long")).withColumn(
        "edited", F.concat(F.expr("substring(t, 1, char_length(t) - cast(floor(char_length(t) / 2) as int))"), F.substring("next_t", F.lit(1), half))
    )
    done = with_bins(edited.drop("t", "next_t", "tie"), "edited", "edited_bins")
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"),
    )
