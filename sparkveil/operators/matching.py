"""Matching joins: indicators, networks, hosts, URLs and ranges.

None of these joins compares all pairs: ranges are turned into equal keys (masked prefixes, label
suffixes, path prefixes), so both sides are hashed on a key and Catalyst picks broadcast or shuffle by
measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parts import dealt_by
from .networks import dealt

#: The public suffixes of more than one label that the splitter knows beside single labels.
SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
#: Special-purpose IPv4 ranges (first address, prefix length).
SPECIAL_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def masked(ip_num: str, prefix_len: str) -> str:
    """Expression of the first address of the network of an address."""
    return f"({ip_num} - {ip_num} % shiftleft(1L, 32 - {prefix_len}))"


def exact_matches(targets: DataFrame, indicators: DataFrame) -> DataFrame:
    """Targets (target, kind, key) that are listed, with the confidence of their kind."""
    confidence = F.when(F.col("kind") == "hash", 0.98).otherwise(0.95)
    return targets.join(indicators, ["kind", "key"]).select("target", "kind", "key", "list", confidence.alias("confidence"))


def in_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """All (address, network) pairs where the network holds the address: an equal join on the masked address.

    Each IPv4 address is probed once for each of the 33 prefix lengths, whatever the number of networks is.
    ``operators.networks`` knows both families, probes only lengths that occur and spreads short prefixes.
    """
    probes = dealt(addresses).withColumn("prefix_len", F.explode(F.expr("sequence(0, 32)"))).withColumn("lo", F.expr(masked("ip_num", "prefix_len")))
    return probes.join(networks, ["prefix_len", "lo"])


def longest_prefix(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """The most specific network of each address; ties go to the first provider name."""
    best = F.max_by(F.struct("provider", "prefix_len", "region"), F.struct("prefix_len", F.expr("-rank"))).alias("n")
    ranked = networks.withColumn("rank", F.row_number().over(Window.partitionBy("lo", "prefix_len").orderBy("provider"))).where("rank = 1")
    return in_networks(addresses, ranked).groupBy("target", "ip").agg(best).select("target", "ip", "n.*")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of overlapping networks of two tables: of two CIDR blocks that overlap one holds the other,
    so each block is joined with its own enclosing prefixes of the other side."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in ("provider", "prefix_len", "lo", "hi")])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in ("provider", "prefix_len", "lo", "hi")])
    up = lambda df, side: df.withColumn("p", F.explode(F.expr(f"sequence(0, {side}_prefix_len)"))).withColumn("k", F.expr(masked(f"{side}_lo", "p")))
    inside = up(left, "a").join(right, (F.col("p") == F.col("b_prefix_len")) & (F.col("k") == F.col("b_lo")))
    outside = up(right, "b").join(left, (F.col("p") == F.col("a_prefix_len")) & (F.col("k") == F.col("a_lo")) & (F.col("a_prefix_len") < F.col("b_prefix_len")))
    columns = [*left.columns, *right.columns]
    return inside.select(*columns).union(outside.select(*columns))


def first_members(addresses: DataFrame, networks: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` addresses, by address, of each provider's networks.

    A network's first members are found once, however many providers have it; parts of its addresses are cut first.
    """
    key, order = ["prefix_len", "lo"], ["ip_num", "target"]
    hits = in_networks(addresses, networks.select(*key).distinct()).withColumn("_salt", F.pmod(F.xxhash64("target", "ip"), F.lit(64)))
    cut = lambda df, by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most).drop("place")
    first = cut(cut(hits, [*key, "_salt"]), key)
    few = networks.select("provider", *key).join(first, key)
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy("provider").orderBy(*order))).where(F.col("place") <= most)
    return placed.select("provider", "target", "ip", "place")


def host_suffixes(df: DataFrame, host: str = "host") -> DataFrame:
    """One row for each suffix of the host's labels, with ``depth`` labels cut off."""
    labels = df.withColumn("_l", F.split(host, r"\."))
    cut = labels.select("*", F.posexplode(F.transform("_l", lambda x, i: F.array_join(F.slice("_l", i + 1, F.size("_l")), "."))).alias("depth", "suffix"))
    return cut.drop("_l")


def parent_matches(targets: DataFrame, listed: DataFrame) -> DataFrame:
    """The nearest listed parent (never a bare top-level label) of each target host."""
    up = host_suffixes(targets).where("depth > 0 and instr(suffix, '.') > 0")
    hits = up.join(listed.select(F.col("key").alias("suffix")).distinct(), "suffix")
    return hits.groupBy("target", "host").agg(F.min_by("suffix", "depth").alias("parent")).withColumn("confidence", F.lit(0.6))


def subdomain_members(domains: DataFrame, listed: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` listed hosts below each domain, by name."""
    below = host_suffixes(listed.select(F.col("key").alias("host")).distinct()).where("depth > 0")
    hits = below.join(domains.select(F.col("domain").alias("suffix")).distinct(), "suffix")
    order = Window.partitionBy("suffix").orderBy("host")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).selectExpr("suffix as domain", "host", "place", "0.85D as confidence")


def in_scope(hosts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Hosts that equal a scope or lie below one."""
    hits = host_suffixes(hosts).join(scopes.select(F.col("scope").alias("suffix")).distinct(), "suffix", "left_semi")
    return hosts.join(hits.select("host").distinct(), "host", "left_semi")


def path_prefixes(df: DataFrame, url: str = "url") -> DataFrame:
    """One row for each path prefix of a URL (scheme and host first), with trailing slashes cut."""
    plain = df.withColumn("_u", F.regexp_replace(F.col(url), "/+$", ""))
    pieces = plain.withColumn("_p", F.split(F.regexp_replace("_u", "^[a-z]+://", ""), "/")).withColumn("_s", F.regexp_extract("_u", "^[a-z]+://", 0))
    rows = pieces.select("*", F.posexplode(F.transform("_p", lambda x, i: F.concat("_s", F.array_join(F.slice("_p", F.lit(1), i + 1), "/")))).alias("depth", "prefix"))
    return rows.drop("_p", "_s")


def url_prefix_matches(targets: DataFrame, listed: DataFrame) -> DataFrame:
    """Targets whose URL lies below a listed URL or above one, without an exact hit; the longest, then
    smallest listed URL is given."""
    exact = targets.join(listed.select(F.col("key").alias("url")).distinct(), "url", "left_anti")
    a = path_prefixes(exact).select("target", "url", F.col("_u").alias("own"), "prefix")
    b = path_prefixes(listed.select("key").distinct(), "key").select("key", F.col("_u").alias("listed_own"), F.col("prefix").alias("listed_prefix"))
    whole = dealt_by(b.where("listed_prefix = listed_own").select("key", "listed_own"), "listed_own")
    above = dealt_by(a.drop("own"), "prefix").join(whole, F.col("prefix") == F.col("listed_own")).select("target", "url", "key")
    below = dealt_by(a.where("prefix = own").drop("prefix"), "own").join(dealt_by(b.drop("listed_own"), "listed_prefix"), F.col("own") == F.col("listed_prefix")).select("target", "url", "key")
    best = F.max_by("key", F.struct(F.length("key"), F.expr("-rank")))
    hits = dealt_by(above.union(below), "target").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("key")))
    return hits.groupBy("target", "url").agg(best.alias("listed")).withColumn("confidence", F.lit(0.9))


def registrable(df: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``suffix`` (longest known public suffix) and ``registrable`` (one label more) to hosts."""
    n = F.size(F.split(host, r"\."))
    two = F.substring_index(F.col(host), ".", -2)
    suffix = F.when((n > 1) & two.isin(*SUFFIXES), two).otherwise(F.substring_index(F.col(host), ".", -1))
    labels = F.size(F.split(suffix, r"\."))
    whole = F.when(n > labels, F.array_join(F.slice(F.split(host, r"\."), -(labels + 1), labels + 1), "."))
    return df.withColumn("suffix", suffix).withColumn("registrable", whole)


def is_public(ip_num: str = "ip_num"):
    """Whether an address is in none of the special-purpose ranges."""
    hits = [F.col(ip_num).between(number(ip), number(ip) + 2 ** (32 - p) - 1) for ip, p in SPECIAL_RANGES]
    inside = hits[0]
    for h in hits[1:]:
        inside = inside | h
    return ~inside


def neighbours(addresses: DataFrame, span: int = 4) -> DataFrame:
    """Addresses up to ``span`` away within the same /24, nearest first."""
    base = F.expr(masked("ip_num", "24"))
    rows = addresses.withColumn("near_num", F.explode(F.expr(f"sequence(ip_num - {span}, ip_num + {span})"))).where("near_num <> ip_num")
    inside = rows.where((F.col("near_num") > base) & (F.col("near_num") < base + 255))
    order = Window.partitionBy("target").orderBy(F.abs(F.col("near_num") - F.col("ip_num")), "near_num")
    return inside.withColumn("place", F.row_number().over(order)).select("target", "ip", dotted("near_num").alias("near"), "place")


def dotted(ip_num: str):
    """The dotted form of a numeric address."""
    n = F.col(ip_num)
    parts = [F.floor(n / F.lit(256**k)) % 256 for k in (3, 2, 1, 0)]
    return F.concat_ws(".", *[p.cast("bigint").cast("string") for p in parts])


def expand(networks: DataFrame, most: int = 256) -> DataFrame:
    """The first ``most`` host addresses of each network (its first and last address are no hosts)."""
    hosts = F.expr(f"sequence(lo + 1, least(hi - 1, lo + {most}))")
    return networks.where("prefix_len < 31").select("provider", "prefix_len", F.explode(hosts).alias("ip_num")).withColumn("ip", dotted("ip_num"))


def reverse_labels(addresses: DataFrame) -> DataFrame:
    """The reverse-DNS name of each address."""
    return addresses.withColumn("name", F.concat(F.concat_ws(".", F.reverse(F.split("ip", r"\."))), F.lit(".in-addr.arpa")))


def radius_pairs(centres: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """Pairs of a centre (cid, clat, clon) and a point (pid, lat, lon) within ``metres``, by one-degree cells.

    A centre is sent to all cells that its circle's box meets, a point to its own; longitudes wrap, and boxes
    that meet a pole take all longitudes.
    """
    reach = metres / 111_000.0
    lats = F.sequence(F.floor(F.col("clat") - reach).cast("int"), F.floor(F.col("clat") + reach).cast("int"))
    edge = F.least(F.abs("clat") + reach, F.lit(89.9))
    wide = F.least(F.lit(180.0), F.lit(reach) / F.cos(F.radians(edge)))
    lons = F.sequence(F.floor(F.col("clon") - wide).cast("int"), F.floor(F.col("clon") + wide).cast("int"))
    cells = centres.withColumn("y", F.explode(lats)).withColumn("x", F.explode(F.array_distinct(F.transform(lons, lambda v: F.pmod(v + 180, F.lit(360))))))
    homes = points.withColumn("y", F.floor("lat").cast("int")).withColumn("x", F.pmod(F.floor("lon").cast("int") + 180, F.lit(360)))
    from ..functions.geo import haversine_m

    near = cells.join(homes, ["y", "x"]).withColumn("d", haversine_m("clat", "clon", "lat", "lon"))
    return near.where(F.col("d") <= metres).drop("y", "x")


def address_order(addresses: DataFrame, ranges: int | None = None) -> DataFrame:
    """All rows (target, ip, ip_num) in address order with their place in the whole table.

    Bounds from a sample of fixed size deal the rows to ranges; a row's place is its place within its range and the
    number of rows of the ranges before, so that no task holds more than a range.
    """
    spark = addresses.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("ip_num", "target")
    sample = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0) for r in addresses.select("ip_num", "target").orderBy(F.xxhash64("ip_num", "target")).limit(20 * n).collect()))
    picked = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    bounds = [F.struct(F.lit(i if a else None).cast("long").alias("ip_num"), F.lit(t if c else None).cast("long").alias("target")) for a, i, c, t in picked]
    at = F.size(F.filter(F.array(*bounds), lambda x: x <= key)) if bounds else F.lit(0)
    dealt = addresses.select("target", "ip", "ip_num").withColumn("_range", at)
    before = dealt.groupBy("_range").count().selectExpr("_range", "sum(count) over (order by _range) - count as before")  # a row a range
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy("ip_num", "target")))
    return inside.join(F.broadcast(before), "_range").select("target", "ip", (F.col("before") + F.col("_in")).alias("place")).orderBy("place")
