"""Addresses and networks of both families, IPv4 and IPv6, with prefixes of 0 to 128 bits.

An address is two signed 64-bit columns, ``hi`` and ``lo``, that hold its bits from the left (an IPv4
address fills the upper half of ``hi``), and its ``family``, 4 or 6. A network is the same with
``prefix_len``, its free bits zero. Masks are bit operations on columns, so a network holds an address
exactly if both agree in the bits that the mask keeps, and joins are equal joins.

Only prefix lengths that occur in the network table are probed. Networks shorter than ``SPREAD`` bits,
whose key nearly every address shares, are kept once for each of their parts of that length, so that
their matches are spread over tasks by the first bits of the address.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 8
WIDTH = {4: 32, 6: 128}
_SIGN = -(1 << 63)

#: Special-purpose blocks whose addresses aren't public, and blocks inside these that are (IANA registries).
NOT_PUBLIC = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 "
    "198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 ::/128 ::1/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 3fff::/20 "
    "fc00::/7 fe80::/10 ff00::/8"
).split()
PUBLIC_INSIDE = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _four(text: Column) -> Column:
    """Eight hex digits of a dotted address; null unless it has four numbers up to 255 without leading zeros."""
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    octets = F.transform(F.split(text, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0"))
    return F.when(text.rlike(rf"^{part}\.{part}\.{part}\.{part}$"), F.array_join(octets, ""))


def _six(text: Column) -> Column:
    """32 hex digits of an IPv6 address in any of its written forms; null if it is none."""
    tail = F.regexp_extract(text, r"[0-9]+\.[0-9.]+$", 0)
    hex4 = _four(tail)
    plain = F.when(tail == "", text).otherwise(F.concat(F.expr("''"), F.substring(text, F.lit(1), F.char_length(text) - F.char_length(tail)), F.substring(hex4, 1, 4), F.lit(":"), F.substring(hex4, 5, 4)))

    def digits(t: Column) -> Column:
        halves = F.split(t, "::")
        groups = lambda side: F.filter(F.split(F.coalesce(F.get(halves, side), F.lit("")), ":"), lambda x: x != "")
        n = F.size(groups(0)) + F.size(groups(1))
        whole = t.rlike("^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$")
        short = t.rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$") & (n <= 7)
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
        all_groups = F.concat(groups(0), zeros, groups(1))
        return F.when(whole | short, F.array_join(F.transform(all_groups, lambda x: F.lpad(x, 4, "0")), ""))

    return _let(plain, digits)


def _long(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("long")


def address(text: Column) -> Column:
    """{family, hi, lo} of an address in text; null if it is none."""

    def numbers(t: Column) -> Column:
        four = _let(_four(t), lambda d: F.when(d.isNotNull(), F.struct(F.lit(4).alias("family"), _long(F.concat(d, F.lit("00000000"))).alias("hi"), F.lit(0).cast("long").alias("lo"))))
        six = _let(_six(t), lambda d: F.when(d.isNotNull(), F.struct(F.lit(6).alias("family"), _long(F.substring(d, 1, 16)).alias("hi"), _long(F.substring(d, 17, 16)).alias("lo"))))
        return F.when(F.contains(t, F.lit(":")), six).otherwise(four)

    return _let(F.lower(F.trim(text)), numbers)


def _kept(bits: Column) -> Column:
    """A mask of 64 bits whose upper ``bits`` are ones."""
    return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - bits).cast("int")))


def masked(hi: Column, lo: Column, bits: Column) -> tuple[Column, Column]:
    """The first ``bits`` bits of an address."""
    return hi.bitwiseAND(_kept(bits)), lo.bitwiseAND(_kept(bits - 64))


def located(df: DataFrame, ip: str = "ip") -> DataFrame:
    """``df`` with family, hi and lo of its addresses, null where the text is none."""
    return df.withColumn("_a", address(F.col(ip))).select(*df.columns, "_a.family", "_a.hi", "_a.lo")


def parsed(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``df`` with family, prefix_len, hi and lo of its networks; a bare address is a network of one.

    Free bits that are set are cleared; null where the text is no network.
    """
    pieces = df.withColumn("_p", F.split(F.trim(F.col(cidr)), "/", 2)).withColumn("_a", address(F.get("_p", 0)))
    bits = F.when(F.size("_p") == 1, F.when(F.col("_a.family") == 4, 32).otherwise(128)).when(F.get("_p", 1).rlike("^[0-9]{1,3}$"), F.get("_p", 1).cast("int"))
    whole = pieces.withColumn("_n", bits).withColumn("_ok", F.col("_n") <= F.when(F.col("_a.family") == 4, 32).otherwise(128))
    hi, lo = masked(F.col("_a.hi"), F.col("_a.lo"), F.col("_n"))
    told = {"family": F.col("_a.family"), "prefix_len": F.col("_n"), "hi": hi, "lo": lo}
    return whole.select(*df.columns, *[F.when(F.col("_ok"), c).alias(k) for k, c in told.items()])


def dealt(df: DataFrame, least: int = 96) -> DataFrame:
    """``df`` in many parts, by target if it has one: a small file is few tasks, whose rows grow many times in a join."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)
    return df.repartition(parts, "target") if "target" in df.columns else df.repartition(parts)


def _probes(df: DataFrame, networks: DataFrame) -> DataFrame:
    """``df`` (family, hi, lo, ...) once for each prefix length that ``networks`` has of its family, with the key."""
    lengths = networks.where("prefix_len is not null").groupBy("family").agg(F.collect_set("prefix_len").alias("_lengths"))
    # two rows of at most 129 lengths
    asked = dealt(df).join(F.broadcast(lengths), "family").withColumn("_bits", F.explode("_lengths"))
    hi, lo = masked(F.col("hi"), F.col("lo"), F.greatest(F.col("_bits"), F.lit(SPREAD)))
    return asked.withColumn("_hi", hi).withColumn("_lo", lo).drop("_lengths")


def _keyed(networks: DataFrame) -> DataFrame:
    """Networks under the keys that ``_probes`` asks for."""
    free = F.greatest(SPREAD - F.col("prefix_len"), F.lit(0)).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), free) - 1))
    parts = networks.where("prefix_len is not null").withColumn("_part", part)
    step = F.call_function("shiftleft", F.col("_part").cast("long"), F.lit(64 - SPREAD))
    return parts.withColumn("_hi", F.col("hi").bitwiseOR(step)).withColumn("_lo", F.col("lo")).withColumn("_bits", F.col("prefix_len")).drop("_part", "hi", "lo")


_KEY = ["family", "_bits", "_hi", "_lo"]


def in_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """All pairs of an address (family, hi, lo, ...) and a network (family, prefix_len, hi, lo, ...) that holds it.

    Addresses and networks that couldn't be read (nulls) match nothing.
    """
    return _probes(addresses, networks).join(_keyed(networks), _KEY).drop("_bits", "_hi", "_lo")


def longest_prefix(addresses: DataFrame, networks: DataFrame, told: list[str]) -> DataFrame:
    """The most specific network of each address (target, ip, ...): ``told`` columns; ties go to the least of them."""
    one = networks.groupBy("family", "prefix_len", "hi", "lo").agg(F.min(F.struct(*told)).alias("_n"))
    best = F.max_by("_n", "prefix_len").alias("_n")
    hits = in_networks(addresses, one).groupBy("target", "ip").agg(best, F.max("prefix_len").alias("prefix_len"))
    return hits.select("target", "ip", "prefix_len", "_n.*")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_..., b_...) of networks that share an address: of two that do, one holds the other."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], "family", "hi", "lo", "prefix_len")
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], "family", "hi", "lo", "prefix_len")

    def below(small: DataFrame, large: DataFrame, on: str) -> DataFrame:
        return _probes(small.withColumnRenamed("prefix_len", "_own"), large).join(_keyed(large), _KEY).where(on)

    told = [f"a_{c}" for c in a.columns] + [f"b_{c}" for c in b.columns]
    return below(left, right, "_bits <= _own").select(told).unionByName(below(right, left, "_bits < _own").select(told))


def by_number() -> list[Column]:
    """Columns that put addresses in order of family and number."""
    return [F.col("family"), F.col("hi").bitwiseXOR(F.lit(_SIGN)), F.col("lo").bitwiseXOR(F.lit(_SIGN))]


def first_members(addresses: DataFrame, networks: DataFrame, most: int = 50, salts: int = 64) -> DataFrame:
    """The first ``most`` addresses, by number, of each provider's networks.

    A network's first members are found once, however many providers have it, and parts of its addresses are cut
    first, so that a network that holds most addresses isn't one task's.
    """
    key = ["family", "prefix_len", "hi", "lo"]
    each = networks.select(*key).distinct().withColumns({"_nhi": F.col("hi"), "_nlo": F.col("lo")})
    hits = in_networks(addresses, each).withColumn("_salt", F.pmod(F.xxhash64("target", "ip"), F.lit(salts)))
    order = [*by_number()[1:], F.col("target")]  # by number alone, whatever the family
    own = ["family", "prefix_len", "_nhi", "_nlo"]
    cut = lambda df, by: df.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_p") <= most)
    first = cut(cut(hits, [*own, "_salt"]), own).select(*own, F.struct("hi", "lo", "target", "ip").alias("_a"))
    named = networks.select("provider", *key).withColumnsRenamed({"hi": "_nhi", "lo": "_nlo"})
    few = named.join(first, own).select("provider", "family", "_a.*")
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy("provider").orderBy(*order))).where(F.col("place") <= most)
    return placed.select("provider", "target", "ip", "place")


def digits(a: Column | None = None) -> Column:
    """The 32 hex digits of hi and lo, of the columns or of an ``address``."""
    hi, lo = (F.col("hi"), F.col("lo")) if a is None else (a["hi"], a["lo"])
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def canonical(a: Column | None = None) -> Column:
    """The shortest written form of an address: dotted, or groups with the first longest run of zeros left out."""
    family = F.col("family") if a is None else a["family"]

    def of(d: Column) -> Column:
        dotted = F.concat_ws(".", *[F.conv(F.substring(d, 2 * k + 1, 2), 16, 10) for k in range(4)])
        groups = [F.regexp_replace(F.substring(d, 4 * k + 1, 4), "^0{1,3}", "") for k in range(8)]
        return F.when(family == 4, dotted).when(family == 6, _let(F.concat_ws(":", *groups), shortened))

    def shortened(t: Column) -> Column:
        out = F.when(t == "0:0:0:0:0:0:0:0", "::")
        for k in range(7, 1, -1):
            run = f"(^|:)0(:0){{{k - 1}}}(:|$)"
            sides = F.split(t, run, 2)
            out = out.when(t.rlike(run), F.concat(F.get(sides, 0), F.lit("::"), F.get(sides, 1)))
        return out.otherwise(t)

    return _let(digits(a), of)


def reverse_name() -> Column:
    """The reverse-DNS name of (family, hi, lo): octets or nibbles backwards."""
    octet = lambda k: F.conv(F.substring(digits(), 2 * k + 1, 2), 16, 10)
    four = F.concat(F.concat_ws(".", *map(octet, (3, 2, 1, 0))), F.lit(".in-addr.arpa"))
    six = F.concat(F.array_join(F.reverse(F.split(digits(), "(?<=.)(?=.)")), "."), F.lit(".ip6.arpa"))
    return F.when(F.col("family") == 4, four).when(F.col("family") == 6, six)


def _inside(network: str) -> Column:
    import ipaddress

    n = ipaddress.ip_network(network)
    bits = int(n.network_address) << (0 if n.version == 6 else 96)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hi, lo = masked(F.col("hi"), F.col("lo"), F.lit(n.prefixlen))
    return (F.col("family") == n.version) & (hi == signed(bits >> 64)) & (lo == signed(bits & ((1 << 64) - 1)))


def is_public() -> Column:
    """Whether (family, hi, lo) is an address of the public network; one mapped from IPv4 is what that one is."""
    any_of = lambda networks: F.greatest(*[_inside(n) for n in networks])
    mapped = (F.col("family") == 6) & (F.col("hi") == 0) & (F.shiftrightunsigned("lo", 32) == 0xFFFF)
    inner = [n for n in NOT_PUBLIC if ":" not in n]
    as_four = F.shiftleft("lo", 32)

    def held(network: str) -> Column:
        import ipaddress

        n = ipaddress.ip_network(network)
        bits = int(n.network_address) << 32
        return as_four.bitwiseAND(_kept(F.lit(n.prefixlen))) == (bits - (1 << 64) if bits >> 63 else bits)

    four_public = ~F.greatest(*map(held, inner)) | F.greatest(*map(held, [n for n in PUBLIC_INSIDE if ":" not in n]))
    return F.when(mapped, four_public).otherwise(~any_of(NOT_PUBLIC) | any_of(PUBLIC_INSIDE))
