"""Candidate generators: typosquats, names under other suffixes, buckets, subdomains, service names, file copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes, words and templates that candidates are made of.
TLDS = ("com", "net", "org", "info", "biz", "co", "io", "app", "dev", "xyz", "online", "site", "shop", "store", "us", "uk", "eu", "de", "cn", "ru", "top", "live", "cc", "me")
SUBDOMAINS = ("www", "mail", "vpn", "dev", "api", "admin")
SERVICES = ("_sip._tcp", "_ldap._tcp", "_xmpp-server._tcp", "_kerberos._udp")
BACKUPS = (".bak", ".old", "~", ".zip", ".tar.gz")
#: Glyphs that look alike, and neighbours of keys.
HOMOGLYPHS = {
    "0": ("o",), "1": ("l", "i"), "2": ("z",), "5": ("s",), "6": ("b",), "8": ("b",), "9": ("g", "q"), "b": ("d", "lb", "6"), "c": ("e",), "d": ("b", "cl", "dl"), "e": ("c",), "g": ("q", "9"),
    "h": ("lh",), "i": ("1", "l"), "l": ("1", "i"), "m": ("n", "nn", "rn"), "n": ("m", "r"), "o": ("0",), "q": ("g", "9"), "s": ("5",), "u": ("v",), "v": ("u",), "w": ("vv",), "z": ("2",),
}
KEYBOARD = {
    "1": "2q", "2": "1qw3", "3": "2we4", "4": "3er5", "5": "4rt6", "6": "5ty7", "7": "6yu8", "8": "7ui9", "9": "8io0", "0": "9op",
    "q": "12wa", "w": "3qeasd2", "e": "4wrsdf3", "r": "5etdfg4", "t": "6ryfgh5", "y": "7tughj6", "u": "8yihjk7", "i": "9uojkl8", "o": "0ipkl9", "p": "lo0", "a": "qwsz", "s": "edxzaw", "d": "rfcxse",
    "f": "tgvcdr", "g": "yhbvft", "h": "ujnbgy", "j": "ikmnhu", "k": "olmji", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}
VOWELS = "aeiou"
FUZZERS = ("tld-swap", "addition", "omission", "transposition", "repetition", "replacement", "insertion", "homoglyph", "bitsquatting", "hyphenation", "subdomain", "vowel-swap")


def _each(label: Column, make, last: int = 0, none: str = "array<string>") -> Column:
    """Strings made at each place 1..length - last of the label; none for short labels."""
    n = F.length(label) - last
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), make)).otherwise(F.array().cast(none))


def typosquats(domains: DataFrame, tlds: tuple = TLDS, glyphs: dict = HOMOGLYPHS, bits: int = 8, fuzzers: tuple = FUZZERS) -> DataFrame:
    """(domain, candidate, fuzzer): valid look-alikes of name.tld domains; the first fuzzer in order keeps a duplicate."""
    name, tld = F.substring_index("domain", ".", 1), F.expr("substr(domain, instr(domain, '.') + 1)")
    before = lambda i: F.substring(name, F.lit(1), i - 1)
    after = lambda i: F.substring(name, i + 1, F.length(name))
    at = lambda i: F.substring(name, i, F.lit(1))
    glyph, near = (F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) for t in (glyphs, KEYBOARD))
    changed = lambda table, kept: F.flatten(_each(name, lambda i: F.transform(F.coalesce(table[at(i)], F.array().cast("array<string>")), lambda x: F.concat(before(i), x, at(i) if kept else F.lit(""), after(i))), none="array<array<string>>"))
    letters = F.array(*[F.lit(chr(c)) for c in range(97, 123)])
    whole = lambda array: F.transform(array, lambda x: F.concat(x, F.lit("."), tld))
    flip = lambda i, b: F.char(F.ascii(at(i)).bitwiseXOR(F.pow(F.lit(2), b).cast("int")))
    flips = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: _each(name, lambda i: F.when(flip(i, b).rlike("^[a-z0-9-]$"), F.concat(before(i), flip(i, b), after(i))))))
    flipped = F.filter(flips, lambda x: x.isNotNull())
    vowels = F.array(*map(F.lit, VOWELS))
    swapped = F.flatten(F.transform(vowels, lambda v: F.filter(_each(name, lambda i: F.when(F.contains(F.lit(VOWELS), at(i)), F.concat(before(i), v, after(i)))), lambda x: x.isNotNull())))
    made = {
        "tld-swap": F.transform(F.array(*map(F.lit, tlds)), lambda t: F.concat(name, F.lit("."), t)),
        "addition": whole(F.transform(letters, lambda c: F.concat(name, c))),
        "omission": whole(_each(name, lambda i: F.concat(before(i), after(i)))),
        "transposition": whole(_each(name, lambda i: F.concat(before(i), at(i + 1), at(i), F.substring(name, i + 2, F.length(name))), 1)),
        "repetition": whole(_each(name, lambda i: F.concat(before(i), at(i), at(i), after(i)))),
        "replacement": whole(changed(near, False)),
        "insertion": whole(changed(near, True)),
        "homoglyph": whole(changed(glyph, False)),
        "bitsquatting": whole(flipped),
        "hyphenation": whole(_each(name, lambda i: F.concat(F.substring(name, F.lit(1), i), F.lit("-"), after(i)), 1)),
        "subdomain": whole(_each(name, lambda i: F.concat(F.substring(name, F.lit(1), i), F.lit("."), after(i)), 1)),
        "vowel-swap": whole(swapped),
    }

    def ranked(rank: int, fuzzer: str) -> Column:
        return F.transform(made[fuzzer], lambda c: F.struct(F.lit(rank).alias("rank"), F.lit(fuzzer).alias("fuzzer"), c.alias("candidate")))

    rows = domains.select("domain", F.explode(F.concat(*[ranked(r, f) for r, f in enumerate(fuzzers)])).alias("c")).select("domain", "c.*")
    valid = rows.where((F.col("candidate") != F.col("domain")) & F.col("candidate").rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"))
    return valid.groupBy("domain", "candidate").agg(F.min_by("fuzzer", "rank").alias("fuzzer"))


def other_tlds(domains: DataFrame, tlds: tuple = TLDS) -> DataFrame:
    """The names of domains under every other known suffix."""
    rows = domains.select("domain", F.substring_index("domain", ".", 1).alias("name"), F.explode(F.array(*map(F.lit, tlds))).alias("tld"))
    return rows.select("domain", F.concat_ws(".", "name", "tld").alias("candidate")).where("candidate <> domain")


def buckets(names: DataFrame, most: int = 250) -> DataFrame:
    """Storage bucket names of each base name by template, valid ones only, in order."""
    templates = F.array(F.col("name"), *[F.concat("name", F.lit(s)) for s in ("-backup", "-data", "-dev", ".static", "_logs")], *[F.concat(F.lit(p), "name") for p in ("dev-", "prod-", "www.")])
    rows = names.select("name", F.posexplode(templates).alias("at", "bucket")).where(F.col("bucket").rlike(r"^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("at"))).where(F.col("place") <= most).select("name", "bucket", "place")


def subdomains(domains: DataFrame) -> DataFrame:
    """Host candidates of a word list."""
    return domains.select("domain", F.explode(F.array(*map(F.lit, SUBDOMAINS))).alias("w")).select("domain", F.concat_ws(".", "w", "domain").alias("host")).distinct()


def services(domains: DataFrame) -> DataFrame:
    """Service record names of domains."""
    return domains.select("domain", F.explode(F.array(*map(F.lit, SERVICES))).alias("s")).select("domain", F.concat_ws(".", "s", "domain").alias("name"))


def backup_urls(pages: DataFrame, most: int = 30) -> DataFrame:
    """Addresses of backup copies of a page's file."""
    rows = pages.select("page_id", "url", F.posexplode(F.array(*map(F.lit, BACKUPS))).alias("at", "s")).where(F.col("at") < most)
    return rows.select("page_id", F.concat("url", "s").alias("candidate"))


def usernames(names: DataFrame, sites: dict[str, str]) -> DataFrame:
    """Profile addresses of names on each site; ``sites`` is a small fixed table of templates."""
    pairs = F.array(*[F.struct(F.lit(k).alias("site"), F.lit(v).alias("template")) for k, v in sites.items()])
    return names.select("name", F.explode(pairs).alias("s")).select("name", "s.site", F.expr("replace(s.template, '{}', name)").alias("url"))


def coverage_rows(spark, radius_m: float = 463_000.0, bands: int = 29) -> DataFrame:
    """Latitude bands and the fewest columns with which every tile's corners lie within reach of its centre."""
    from ..functions.geo import haversine_m

    height = 180.0 / bands
    rows = spark.range(bands).select(F.col("id").cast("int").alias("band"), (F.col("id") * height - 90).alias("south"))
    tries = rows.withColumn("columns", F.explode(F.sequence(F.lit(1), F.lit(360))))
    mid = F.col("south") + height / 2
    worst = F.greatest(*[haversine_m(mid, F.lit(0.0), F.col("south") + k * height, F.lit(180.0) / F.col("columns")) for k in (0, 1)])
    return tries.where(worst <= radius_m * 0.97).groupBy("band", "south").agg(F.min("columns").alias("columns"))
