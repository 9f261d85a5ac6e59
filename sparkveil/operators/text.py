"""Identifiers in text: extraction from documents and pages, classification, checks and normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the identifiers that the scanner knows, in order of precedence.
PATTERNS = {
    "url": r"https?://[^\s<>\"']+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "cve": r"\bCVE-[0-9]{4}-[0-9]{4,7}\b",
    "hash": r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "eth": r"\b0x[0-9a-fA-F]{40}\b",
    "mac": r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
}
#: What every hit of a pattern holds.
SIGNS = {"url": "://", "email": "@", "ip": ".", "cve": "CVE-", "eth": "0x", "mac": ":"}
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
COMPANY = r"((?:[A-Z][A-Za-z&]+ ){1,5})(Inc|Ltd|LLC|GmbH|Corp|PLC)\b"
BASE64 = r"[A-Za-z0-9+/]{20,}={0,2}"
TYPES = tuple(PATTERNS)


def found(df: DataFrame, kind: str, pattern: str, keys: list[str], text: str) -> DataFrame:
    """(keys, type, raw, place): every hit of a pattern."""
    hits = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    return df.select(*keys, F.lit(kind).alias("type"), F.posexplode(hits).alias("place", "raw"))


def normal_form(kind: Column, raw: Column) -> Column:
    """The normal form of an identifier of a type."""
    lowered = F.lower(raw)
    return (
        F.when(kind.isin("email", "hash", "eth"), lowered)
        .when(kind.isin("iban"), F.upper(F.regexp_replace(raw, r"\s", "")))
        .when(kind == "mac", F.regexp_replace(lowered, "-", ":"))
        .when(kind == "cve", F.upper(raw))
        .when(kind == "url", F.regexp_replace(raw, r"[.,;:)\]]+$", ""))
        .otherwise(raw)
    )


def scan(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct identifiers of each document: (key, type, value, mentions)."""

    def tagged(kind: str) -> Column:
        hits = F.regexp_extract_all(F.col(text), F.lit(f"({PATTERNS[kind]})"), F.lit(1))
        if kind in SIGNS:  # most texts lack what every hit has, and searching for that is cheap
            hits = F.when(F.contains(text, F.lit(SIGNS[kind])), hits).otherwise(F.array().cast("array<string>"))
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("raw")))

    arrays = [tagged(k) for k in TYPES]
    hits = df.select(key, F.explode(F.concat(*arrays)).alias("h")).select(key, "h.*")
    return hits.groupBy(key, "type", normal_form(F.col("type"), F.col("raw")).alias("value")).agg(F.count("*").alias("mentions"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, F.when(value(i) * 2 > 9, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + doubled(i)) % 10) == 0


def mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN-like string, its first four characters moved to the end and letters as numbers."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(moved, i, F.lit(1)))
    step = lambda s, i: F.when(code(i) >= 65, (s * 100 + code(i) - 55) % 97).otherwise((s * 10 + code(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def cards(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct Luhn-valid card numbers, masked but for the last four digits."""
    hits = found(df, "card", CARD, [key], text).withColumn("digits", F.regexp_replace("raw", "[ -]", ""))
    valid = hits.where(luhn(F.col("digits")) & F.length("digits").between(13, 19))
    masked = F.concat(F.repeat(F.lit("*"), F.length("digits") - 4), F.substring("digits", -4, 4))
    return valid.select(key, masked.alias("card"), F.sha2("digits", 256).alias("fingerprint")).distinct()


def companies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Company names with a legal suffix, once per document and lower-cased name."""
    return found(df, "company", COMPANY.replace("(Inc", "(?:Inc").replace("((?:[A-Z]", "(?:(?:[A-Z]"), [key], text).groupBy(key, F.lower(F.trim("raw")).alias("company")).agg(F.count("*").alias("mentions"))


def base64_blobs(df: DataFrame, key: str, text: str = "text", least: int = 8) -> DataFrame:
    """Base64 runs that decode to at least ``least`` printable ASCII characters."""
    hits = found(df, "base64", BASE64, [key], text).where(F.length("raw") % 4 == 0)
    decoded = hits.withColumn("decoded", F.decode(F.unbase64("raw"), "ISO-8859-1"))
    return decoded.where((F.length("decoded") >= least) & F.col("decoded").rlike(r"^[\x20-\x7E]+$")).select(key, "raw", "decoded").distinct()


def links(pages: DataFrame) -> DataFrame:
    """Links of pages: (page_id, href, target, kind), relative ones resolved against the page's host."""
    hits = found(pages, "link", r"href=\"[^\"]*\"", ["page_id", "url"], "html").withColumn("href", F.regexp_extract("raw", r'href="([^"]*)"', 1))
    root = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    target = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, F.col("href"))).otherwise(F.concat(root, F.lit("/"), F.col("href")))
    return hits.select("page_id", "href", target.alias("target"), link_kind(F.col("href")).alias("kind"), "place")


def link_kind(href: Column) -> Column:
    """asset, file or page, by the extension of a path."""
    ext = F.lower(F.regexp_extract(href, r"\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))
    return F.when(ext.isin("css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff"), "asset").when(ext.isin("pdf", "doc", "docx", "xls", "xlsx", "zip", "gz", "tar", "7z", "csv", "txt"), "file").otherwise("page")


def page_facts(pages: DataFrame) -> DataFrame:
    """Facts of saved pages: title, generator, charset, counts of links, scripts, forms and comments, password forms."""
    html = F.col("html")
    one = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    count = lambda p: F.regexp_count(html, F.lit(p))
    return pages.select(
        "page_id", one(r"(?is)<title[^>]*>([^<]*)</title>").alias("title"), one(r'(?is)<meta[^>]*charset="?([A-Za-z0-9-]+)').alias("charset"),
        count(r"(?i)<a ").alias("links"), count(r"(?i)<script").alias("scripts"), count(r"(?i)<form").alias("forms"), count("<!--").alias("comments"),
        F.lower(html).contains('type="password"').alias("login"),
    )


def classify(df: DataFrame, token: str) -> DataFrame:
    """The best type of each token with its normal form and confidence; ``other`` if nothing fits."""
    t = F.col(token)
    whole = {k: t.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    rules = [
        ("geo", t.rlike(r"^-?[0-9]{1,2}(\.[0-9]+)?, ?-?[0-9]{1,3}(\.[0-9]+)?$"), 0.9), ("url", whole["url"], 0.99), ("email", whole["email"], 0.99), ("ip", whole["ip"], 0.99),
        ("cidr", t.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{1,2}$"), 0.95), ("asn", t.rlike(r"^(?i)as[0-9]{1,10}$"), 0.95), ("cve", whole["cve"], 1.0), ("mac", whole["mac"], 0.95),
        ("eth", whole["eth"], 1.0), ("hash", whole["hash"], 0.9), ("iban", whole["iban"], 0.9), ("username", t.rlike(r"^@[A-Za-z0-9_]{2,30}$"), 0.8),
        ("phone", t.rlike(r"^\+[0-9]{7,15}$"), 0.85), ("hostname", t.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$"), 0.8),
    ]
    kind, confidence = F.lit("other"), F.lit(0.0)
    for name, test, sure in reversed(rules):
        kind, confidence = F.when(test, name).otherwise(kind), F.when(test, sure).otherwise(confidence)
    return df.withColumn("type", kind).withColumn("confidence", confidence).withColumn("normalized", normal_form(F.col("type"), t))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment; null with credentials."""
    head, rest = F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1)), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(head, r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    return F.when((head != "") & ~head.contains("@"), F.concat(plain, F.when(rest == "", F.lit("/")).otherwise(rest)))


def redacted(text: Column) -> Column:
    """Credential query parameters masked."""
    return F.regexp_replace(text, r"(?i)([?&](?:key|token|apikey|secret|password)=)[^&#\s'\"]+", "$1***")


def duration_seconds(text: Column) -> Column:
    """Seconds of 30s, 20m, 6h, 2d, 1w and the words realtime, hourly, daily and weekly; others 3600."""
    unit = F.regexp_extract(text, r"^[0-9]+([smhdw])$", 1)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400).when(unit == "w", 604_800)
    words = F.when(text == "realtime", 5).when(text == "hourly", 3600).when(text == "daily", 86_400).when(text == "weekly", 604_800).when(text == "on_demand", -1)
    return F.coalesce(F.try_to_number(F.regexp_extract(text, r"^([0-9]+)", 1), F.lit("999999")).cast("bigint") * factor, words.cast("bigint"), F.lit(3600).cast("bigint"))


#: Entities that plain text of pages spells out.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip_tags(html: Column) -> Column:
    """Text of a page: tags as blanks, the common entities spelled out, runs of blanks joined."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Letters and digits of a name, lower-cased: ``Example Corp, Inc.`` is ``examplecorp``."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
