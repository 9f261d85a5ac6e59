"""What a token can be: a ranked list of types, each with its normal form and how sure it is.

Forms that only one type has are settled by the first rule that fits; forms that several share give one candidate
for each type, the surest first, in the order of the rules where they are equally sure. Checksums decide on coin
addresses, IBANs and LEIs; host names need a suffix from a table of public suffix rules.

Telephone numbers are taken by shape: a known calling code and 8 to 15 digits, or ten digits of a North American number
with a valid area and exchange code; the number plan of each country isn't known. The capitals of an account of 0x and 40
digits aren't checked, as no function of Spark computes that digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import networks, records, suffixes
from .checksums import coin_address

#: Forms of tokens.
FORMS = {
    "geo": r"^\s*(-?\d{1,2}(?:\.\d+)?)\s*[,\s]\s*(-?\d{1,3}(?:\.\d+)?)\s*$",
    "geo_sides": r"(?i)^\s*(\d{1,2}(?:\.\d+)?)\s*°?\s*([NS])\s*,?\s*(\d{1,3}(?:\.\d+)?)\s*°?\s*([EW])\s*$",
    "url": r"(?i)^(?:https?|ftp)://\S+$", "email": r"^[A-Za-z0-9._%+\-']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$", "asn": r"(?i)^AS(\d{1,10})$", "cve": r"(?i)^CVE-\d{4}-\d{4,}$",
    "mac": r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$", "eth": r"^0x[0-9a-fA-F]{40}$", "btc": r"^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$", "segwit": r"(?i)^(?:bc|tb)1[a-z0-9]{25,87}$",
    "hash": r"^(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$", "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$", "lei": r"^[A-Z0-9]{18}\d{2}$", "username": r"^@[A-Za-z0-9_.\-]{2,64}$",
    "mmsi": r"^\d{9}$", "imo": r"(?i)^IMO\s?(\d{7})$", "icao24": r"^[0-9a-fA-F]{6}$", "callsign": r"^[A-Z]{3}\d{1,4}[A-Z]{0,2}$", "norad": r"^\d{1,6}$", "cell": r"^\d{3}-\d{2,3}-\d{1,5}-\d{1,9}$",
    "host": r"^(?=.{1,253}$)(?:[A-Za-z0-9_](?:[A-Za-z0-9_\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z0-9\-]{2,63}\.?$",
}
_CANDIDATE = "array<struct<type: string, value: string, normalized: string, confidence: double, key: string>>"


def remainder97(text: Column) -> Column:
    """Remainder by 97 of digits and capital letters, letters counted as 10 to 35."""
    code = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda s, c: (s * F.when(F.ascii(c) >= 65, 100).otherwise(10) + code(c)) % 97
    return F.aggregate(F.split(text, "(?<=.)(?=.)"), F.lit(0), step)


def _host(v: Column) -> Column:
    return F.regexp_replace(F.lower(v), r"\.+$", "")


def _network(v: Column, address: Column | None = None) -> Column:
    """The canonical text of a network, its free bits cleared; a bare address is a network of one."""
    a = networks.address(F.substring_index(v, "/", 1)) if address is None else address
    n = F.substring_index(v, "/", -1).try_cast("int")
    bits = F.when(F.contains(v, F.lit("/")), n).otherwise(F.when(F.contains(v, F.lit(":")), 128).otherwise(32))

    def text(x: Column) -> Column:
        hi, lo = networks.masked(x["hi"], x["lo"], bits)
        return networks.canonical(F.struct(x["family"].alias("family"), hi.alias("hi"), lo.alias("lo")))

    return F.concat(F.get(F.transform(F.array(a), text), 0), F.lit("/"), bits.cast("string"))


def _card(v: Column) -> Column:
    d = F.regexp_replace(v, r"\D", "")
    return F.concat(F.substring(d, 1, 6), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.char_length(d) - 10)), F.right(d, F.lit(4)))


def _place(v: Column) -> Column:
    at = lambda i: F.get(F.split(v, r"[,\s]+"), i).try_cast("double")
    number = lambda i: F.when(at(i).isNotNull(), F.format_string("%.6f", at(i)))
    return F.concat(number(0), F.lit(","), number(1))


#: Normal forms by type; values of other types stay as they are.
NORMAL = {
    ("ip",): lambda v: networks.canonical(networks.address(v)), ("netblock",): _network, ("asn",): lambda v: F.concat(F.lit("AS"), F.trim(F.regexp_replace(v, "(?i)^as", ""))),
    ("domain", "hostname", "similar_domain"): _host, ("email",): lambda v: F.concat(F.lower(F.regexp_extract(v, "^(.*)@", 1)), F.lit("@"), _host(F.regexp_extract(v, "@([^@]*)$", 1))),
    ("phone",): lambda v: F.regexp_replace(v, r"[^\d+]", ""), ("username",): lambda v: F.lower(F.regexp_replace(v, "^@+", "")), ("hash", "eth_address"): F.lower,
    ("wifi_ap",): lambda v: F.replace(F.lower(v), F.lit("-"), F.lit(":")), ("iban", "lei"): lambda v: F.upper(F.regexp_replace(v, r"\s+", "")), ("credit_card",): _card,
    ("person", "company", "keyword", "country"): lambda v: F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))), ("geo_point",): _place,
}


def normal_of(kind: str, value: Column) -> Column:
    """The form under which values of one type are compared; a value that the form doesn't fit stays as it is."""
    v = F.trim(value)
    return next((F.coalesce(form(v), v) for kinds, form in NORMAL.items() if kind in kinds), v)


def normal(kind: Column, value: Column) -> Column:
    """The same for a column of types."""
    v = F.trim(value)
    fits = [F.when(kind.isin(*kinds), form(v)) for kinds, form in NORMAL.items()]
    return F.coalesce(*fits, v)


def _told(kind: str, value: Column, sure: float | Column, key: str | None = None, form: Column | None = None) -> Column:
    confidence = F.lit(sure) if isinstance(sure, float) else sure
    normalized = normal_of(kind, value) if form is None else form
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), normalized.alias("normalized"), confidence.cast("double").alias("confidence"), F.lit(key).cast("string").alias("key"))


def ranked(df: DataFrame, token: str, rules: DataFrame, out: str = "candidates") -> DataFrame:
    """``df`` with ``out``: [{type, value, normalized, confidence, key}] of each token, best first; empty if it fits nothing.

    ``rules`` are those of ``suffixes.parsed_rules``. A null or blank token has no candidates.
    """
    t, (f_t, f_host, f_coin, f_address, f_reg, f_suffix) = F.trim(F.col(token)), ("_token", "_host", "_coin", "_address", "registrable", "suffix")
    is_ = lambda form, x=None: (F.col(f_t) if x is None else x).rlike(FORMS[form])
    inner = df.select(F.struct("*").alias("_row"), F.coalesce(t, F.lit("")).alias(f_t))
    head = F.when(F.contains(f_t, F.lit("/")), F.substring_index(f_t, "/", 1)).otherwise(F.col(f_t))
    inner = inner.withColumn(f_host, F.when(is_("host", head), F.regexp_replace(F.lower(head), r"\.$", "")))
    inner = inner.withColumn(f_coin, coin_address(F.when(is_("btc") | is_("segwit"), F.col(f_t))))
    inner = inner.withColumn(f_address, networks.address(F.substring_index(f_t, "/", 1)))
    rows = suffixes.with_registrable(inner, rules, f_host, unlisted=False)
    x = F.col(f_t)
    part = lambda form, i: F.regexp_extract(x, FORMS[form], i)
    lat, lon = part("geo", 1).try_cast("double"), part("geo", 2).try_cast("double")
    signed = lambda i, low: part("geo_sides", i).try_cast("double") * F.when(F.upper(part("geo_sides", i + 1)) == low, -1).otherwise(1)
    place = lambda a, o: F.concat(a.cast("string"), F.lit(","), o.cast("string"))
    address, slash = F.col(f_address), F.contains(x, F.lit("/"))
    block = slash & address.isNotNull() & x.rlike(r"^[^/]*/\d{1,3}$")
    bits = F.substring_index(x, "/", -1).try_cast("int")
    fits = block & (bits <= F.when(F.contains(x, F.lit(":")), 128).otherwise(32))
    only = [
        (is_("geo") & lat.between(-90, 90) & lon.between(-180, 180), _told("geo_point", place(lat, lon), 1.0)), (is_("geo_sides"), _told("geo_point", place(signed(1, "S"), signed(3, "W")), 1.0)),
        (is_("url"), _told("url", x, 1.0)), (is_("email"), _told("email", x, 0.99)), (address.isNotNull() & ~slash, _told("ip", x, 1.0, form=networks.canonical(address))), (fits, _told("netblock", x, 1.0, form=_network(x, address))), (is_("asn"), _told("asn", x, 1.0)),
        (is_("cve"), _told("vulnerability", F.upper(x), 1.0, "cve")), (is_("mac"), _told("wifi_ap", x, 0.95, "bssid")), (is_("eth"), _told("eth_address", x, 1.0)),
        (F.coalesce(F.col(f_coin), F.lit(False)), _told("btc_address", x, 0.98)), (is_("imo"), _told("vessel", part("imo", 1), 0.95, "imo")), (is_("cell"), _told("cell_tower", x, 0.9, "mcc-mnc-lac-cid")), (is_("username"), _told("username", x, 0.9)),
    ]
    national = F.regexp_replace(x, r"\D", "")
    plus = F.startswith(x, F.lit("+"))
    abroad = plus & x.rlike(r"^\+[\d ().\-]+$") & F.char_length(national).between(8, 15) & records.phone_country(F.concat(F.lit("+"), national)).isNotNull()
    american = ~plus & x.rlike(r"^[\d ().\-]*$") & x.rlike(r"[() .\-]") & national.rlike(r"^1?[2-9]\d{2}[2-9]\d{6}$")
    named = F.col(f_suffix).isNotNull() & F.col(f_reg).isNotNull()
    bare = named & ~F.contains(x, F.lit("/"))
    mid = F.substring(x, 1, 3).try_cast("int")
    several = [
        (is_("hash"), _told("hash", x, 0.9)), (is_("iban") & (remainder97(F.concat(F.expr(f"substr({f_t}, 5)"), F.substring(x, 1, 4))) == 1), _told("iban", x, 0.95)), (is_("lei") & (remainder97(x) == 1), _told("lei", x, 0.9)),
        (abroad | american, _told("phone", x, F.when(plus, 0.95).otherwise(0.7), form=F.when(plus, F.concat(F.lit("+"), national)).otherwise(national))),
        (is_("mmsi"), _told("vessel", x, F.when(mid.between(200, 775), 0.6).otherwise(0.3), "mmsi")), (is_("norad"), _told("satellite", x, 0.35, "norad")),
        (is_("icao24") & ~x.rlike(r"^\d+$"), _told("aircraft", F.lower(x), 0.45, "icao24")), (is_("callsign"), _told("aircraft", F.upper(x), 0.35, "callsign")),
        (bare & (F.col(f_host) != F.col(f_reg)), _told("hostname", F.col(f_host), 0.95)), (bare & (F.col(f_host) == F.col(f_reg)), _told("domain", F.col(f_host), 0.95)),
        (named & F.contains(x, F.lit("/")), _told("url", F.concat(F.lit("https://"), x), 0.8)),
    ]
    all_ = F.array_compact(F.array(*[F.when(test, made) for test, made in several]))
    order = F.transform(all_, lambda c, i: F.struct((-c["confidence"]).alias("s"), i.alias("i"), c.alias("c")))
    found = F.when(x == "", F.array().cast(_CANDIDATE))
    for test, made in only:
        found = found.when(test, F.array(made))
    found = found.otherwise(F.transform(F.array_sort(order), lambda o: o["c"]))
    kept = [f"_row.`{c}`" for c in df.columns if c != out]
    return rows.select(*kept, found.cast(_CANDIDATE).alias(out))
