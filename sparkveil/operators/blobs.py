"""What texts and files carry inside: data URIs, wide strings, known secrets, countries of account numbers, links of all kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detection import remainder97


def data_uris(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, mime, bytes, sha256) of the base64 data URIs of texts, distinct; missing padding is made up for.

    A payload that is no base64 gives nothing; a missing type is text/plain.
    """
    form = r"(?i)data:([a-z0-9.+/-]*)(?:;[a-z0-9=.+-]+)*;base64,([a-z0-9+/_-]+)"
    hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(form), F.lit(1)).alias("mime"), F.regexp_extract_all(text, F.lit(form), F.lit(2)).alias("body"))
    rows = df.where(F.contains(F.lower(text), F.lit("data:"))).select(key, F.explode(hits).alias("u")).select(key, "u.*")
    body = F.translate("body", "-_", "+/")
    whole = F.rpad(body, (F.ceil(F.char_length(body) / 4) * 4).cast("int"), "=")
    raw = rows.where(F.char_length("body") % 4 != 1).withColumn("raw", F.try_to_binary(whole, F.lit("base64"))).where("raw is not null")
    mime = F.when(F.col("mime") == "", "text/plain").otherwise(F.lower("mime"))
    return raw.select(key, mime.alias("mime"), F.octet_length("raw").cast("long").alias("bytes"), F.sha2("raw", 256).alias("sha256")).distinct()


def wide_strings(df: DataFrame, key: str, content: str, least: int = 4) -> DataFrame:
    """(key, string): printable runs of ``least`` characters or more in UTF-16 of files, least byte first, distinct."""
    text = F.decode(F.col(content), "ISO-8859-1")
    runs = F.regexp_extract_all(text, F.lit(rf"((?:[\x20-\x7E]\x00){{{least},}})"), F.lit(1))
    return df.select(key, F.explode(F.array_distinct(F.transform(runs, lambda r: F.regexp_replace(r, r"\x00", "")))).alias("string"))


def without_known(text: Column, secrets: list[str], mask: str = "***") -> Column:
    """A text without the values of ``secrets``, the longest first, so that none is left that begins another one.

    Values of fewer than four characters are left alone: they stand in too many words.
    """
    out = text
    for value in sorted({s for s in secrets if len(s) >= 4}, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(value), F.lit(mask))
    return out


def account_country(iban: Column) -> Column:
    """The country of an account number (IBAN) that passes its check, else null; blanks and small letters are no matter."""
    plain = F.upper(F.regexp_replace(iban, r"\s", ""))
    moved = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))
    return F.when(plain.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (remainder97(moved) == 1), F.substring(plain, 1, 2))


def _without_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    folder = last.isin("", ".", "..")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(folder & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolved(base: Column, href: Column) -> Column:
    """The address that ``href`` names on a page at ``base``, without its fragment; null for those that name no page."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    root, scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    asked, body = F.regexp_extract(h, r"(\?.*)$", 1), F.regexp_replace(h, r"\?.*$", "")
    query = F.when((body == "") & (asked == ""), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)).otherwise(asked)  # a mere fragment keeps it
    folder = F.concat(F.regexp_replace(path, "[^/]*$", ""), body)
    inner = F.when(body == "", F.when(path == "", "/").otherwise(path)).when(F.startswith(body, F.lit("/")), _without_dots(body)).otherwise(_without_dots(F.concat(F.lit("/"), folder)))
    other = h.rlike("(?i)^(?:javascript|mailto|tel|data|about):")
    return F.when(other | (h == "") & (F.trim(href) == ""), None).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h)).otherwise(F.concat(root, inner, query))


def all_links(pages: DataFrame) -> DataFrame:
    """(page_id, via, target): where the links, frames and refreshes of pages (page_id, url, html) lead, distinct.

    Attributes may be quoted either way or not at all; a quoted ``>`` ends a tag. A page's first ``base`` stands for its address.
    """
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    forms = {
        "link": rf"(?is)<(?:a|area)\b[^>]*?\bhref{value}", "frame": rf"(?is)<i?frame\b[^>]*?\bsrc{value}",
        "refresh": r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*?content\s*=\s*["'][^"'>]*?url\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""",
    }

    def found(form: str) -> Column:
        groups = [F.regexp_extract_all("html", F.lit(form), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)]
        return F.transform(F.arrays_zip(*groups), lambda z: F.concat(F.coalesce(z["g1"], F.lit("")), F.coalesce(z["g2"], F.lit("")), F.coalesce(z["g3"], F.lit(""))))

    named = F.get(found(rf"(?is)<base\b[^>]*?\bhref{value}"), 0)
    based = pages.where("html is not null").select("page_id", "html", F.coalesce(resolved(F.col("url"), named), "url").alias("base"))
    each = F.concat(*[F.transform(found(f), _told(via)) for via, f in forms.items()])
    rows = based.select("page_id", "base", F.explode(each).alias("l"))
    return rows.select("page_id", "l.via", resolved(F.col("base"), F.col("l.href")).alias("target")).where("target is not null").distinct()


def _told(via: str):
    return lambda h: F.struct(F.lit(via).alias("via"), h.alias("href"))
