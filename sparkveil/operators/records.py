"""More feed layouts, text finders, planning and search parts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feeds import finite, placed, split_good
from .text import found

#: Root codes of news events, countries with aliases and calling codes, person-name stop words, file extensions of interest.
NEWS_ROOTS = {"01": "statement", "02": "appeal", "04": "consult", "14": "protest", "18": "assault", "19": "fight"}
COUNTRIES = {
    "afghanistan": "AF", "albania": "AL", "algeria": "DZ", "andorra": "AD", "angola": "AO", "argentina": "AR", "armenia": "AM", "australia": "AU", "austria": "AT",
    "azerbaijan": "AZ", "bahamas": "BS", "bahrain": "BH", "bangladesh": "BD", "barbados": "BB", "belarus": "BY", "belgium": "BE", "belize": "BZ", "benin": "BJ",
    "bhutan": "BT", "bolivia": "BO", "bosnia and herzegovina": "BA", "botswana": "BW", "brazil": "BR", "brunei": "BN", "bulgaria": "BG", "burkina faso": "BF", "burundi": "BI",
    "cambodia": "KH", "cameroon": "CM", "canada": "CA", "cape verde": "CV", "central african republic": "CF", "chad": "TD", "chile": "CL", "china": "CN", "colombia": "CO",
    "comoros": "KM", "congo": "CG", "democratic republic of the congo": "CD", "costa rica": "CR", "ivory coast": "CI", "croatia": "HR", "cuba": "CU", "cyprus": "CY",
    "czech republic": "CZ", "denmark": "DK", "djibouti": "DJ", "dominica": "DM", "dominican republic": "DO", "ecuador": "EC", "egypt": "EG", "el salvador": "SV",
    "equatorial guinea": "GQ", "eritrea": "ER", "estonia": "EE", "eswatini": "SZ", "ethiopia": "ET", "fiji": "FJ", "finland": "FI", "france": "FR", "gabon": "GA",
    "gambia": "GM", "georgia": "GE", "germany": "DE", "ghana": "GH", "greece": "GR", "grenada": "GD", "guatemala": "GT", "guinea": "GN", "guinea-bissau": "GW", "guyana": "GY",
    "haiti": "HT", "honduras": "HN", "hong kong": "HK", "hungary": "HU", "iceland": "IS", "india": "IN", "indonesia": "ID", "iran": "IR", "iraq": "IQ", "ireland": "IE",
    "israel": "IL", "italy": "IT", "jamaica": "JM", "japan": "JP", "jordan": "JO", "kazakhstan": "KZ", "kenya": "KE", "kiribati": "KI", "north korea": "KP",
    "south korea": "KR", "kosovo": "XK", "kuwait": "KW", "kyrgyzstan": "KG", "laos": "LA", "latvia": "LV", "lebanon": "LB", "lesotho": "LS", "liberia": "LR", "libya": "LY",
    "liechtenstein": "LI", "lithuania": "LT", "luxembourg": "LU", "macau": "MO", "madagascar": "MG", "malawi": "MW", "malaysia": "MY", "maldives": "MV", "mali": "ML",
    "malta": "MT", "marshall islands": "MH", "mauritania": "MR", "mauritius": "MU", "mexico": "MX", "micronesia": "FM", "moldova": "MD", "monaco": "MC", "mongolia": "MN",
    "montenegro": "ME", "morocco": "MA", "mozambique": "MZ", "myanmar": "MM", "namibia": "NA", "nauru": "NR", "nepal": "NP", "netherlands": "NL", "new zealand": "NZ",
    "nicaragua": "NI", "niger": "NE", "nigeria": "NG", "north macedonia": "MK", "norway": "NO", "oman": "OM", "pakistan": "PK", "palau": "PW", "palestine": "PS",
    "panama": "PA", "papua new guinea": "PG", "paraguay": "PY", "peru": "PE", "philippines": "PH", "poland": "PL", "portugal": "PT", "puerto rico": "PR", "qatar": "QA",
    "romania": "RO", "russia": "RU", "rwanda": "RW", "saint kitts and nevis": "KN", "saint lucia": "LC", "saint vincent and the grenadines": "VC", "samoa": "WS",
    "san marino": "SM", "sao tome and principe": "ST", "saudi arabia": "SA", "senegal": "SN", "serbia": "RS", "seychelles": "SC", "sierra leone": "SL", "singapore": "SG",
    "slovakia": "SK", "slovenia": "SI", "solomon islands": "SB", "somalia": "SO", "south africa": "ZA", "south sudan": "SS", "spain": "ES", "sri lanka": "LK", "sudan": "SD",
    "suriname": "SR", "sweden": "SE", "switzerland": "CH", "syria": "SY", "taiwan": "TW", "tajikistan": "TJ", "tanzania": "TZ", "thailand": "TH", "timor-leste": "TL",
    "togo": "TG", "tonga": "TO", "trinidad and tobago": "TT", "tunisia": "TN", "turkey": "TR", "turkmenistan": "TM", "tuvalu": "TV", "uganda": "UG", "ukraine": "UA",
    "united arab emirates": "AE", "united kingdom": "GB", "united states": "US", "uruguay": "UY", "uzbekistan": "UZ", "vanuatu": "VU", "vatican city": "VA", "venezuela": "VE",
    "vietnam": "VN", "yemen": "YE", "zambia": "ZM", "zimbabwe": "ZW", "usa": "US", "u.s.a.": "US", "u.s.": "US", "united states of america": "US", "america": "US", "uk": "GB",
    "u.k.": "GB", "great britain": "GB", "britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "uae": "AE", "russian federation": "RU",
    "prc": "CN", "people's republic of china": "CN", "republic of korea": "KR", "korea": "KR", "dprk": "KP", "czechia": "CZ", "holland": "NL", "the netherlands": "NL",
    "türkiye": "TR", "turkiye": "TR", "cote d'ivoire": "CI", "côte d'ivoire": "CI", "burma": "MM", "swaziland": "SZ", "macedonia": "MK", "viet nam": "VN",
    "iran, islamic republic of": "IR", "syrian arab republic": "SY", "lao": "LA", "drc": "CD", "dr congo": "CD", "republic of the congo": "CG",
    "taiwan, province of china": "TW", "hong kong sar": "HK", "vatican": "VA", "holy see": "VA", "east timor": "TL", "cabo verde": "CV", "saint kitts": "KN",
    "st. lucia": "LC", "moldova, republic of": "MD", "bosnia": "BA", "deutschland": "DE",
}
#: Calling codes of countries; parts of a shared code that have a country of their own are longer.
CALLING_CODES = {
    "1": "US", "1242": "BS", "1246": "BB", "1264": "AI", "1268": "AG", "1284": "VG", "1340": "VI", "1345": "KY", "1441": "BM", "1473": "GD", "1649": "TC", "1658": "JM",
    "1664": "MS", "1670": "MP", "1671": "GU", "1684": "AS", "1721": "SX", "1758": "LC", "1767": "DM", "1784": "VC", "1787": "PR", "1809": "DO", "1829": "DO", "1849": "DO",
    "1868": "TT", "1869": "KN", "1876": "JM", "1939": "PR", "7": "RU", "76": "KZ", "77": "KZ", "20": "EG", "211": "SS", "212": "MA", "213": "DZ", "216": "TN", "218": "LY",
    "220": "GM", "221": "SN", "222": "MR", "223": "ML", "224": "GN", "225": "CI", "226": "BF", "227": "NE", "228": "TG", "229": "BJ", "230": "MU", "231": "LR", "232": "SL",
    "233": "GH", "234": "NG", "235": "TD", "236": "CF", "237": "CM", "238": "CV", "239": "ST", "240": "GQ", "241": "GA", "242": "CG", "243": "CD", "244": "AO", "245": "GW",
    "246": "IO", "247": "AC", "248": "SC", "249": "SD", "250": "RW", "251": "ET", "252": "SO", "253": "DJ", "254": "KE", "255": "TZ", "256": "UG", "257": "BI", "258": "MZ",
    "260": "ZM", "261": "MG", "262": "RE", "263": "ZW", "264": "NA", "265": "MW", "266": "LS", "267": "BW", "268": "SZ", "269": "KM", "27": "ZA", "290": "SH", "291": "ER",
    "297": "AW", "298": "FO", "299": "GL", "30": "GR", "31": "NL", "32": "BE", "33": "FR", "34": "ES", "350": "GI", "351": "PT", "352": "LU", "353": "IE", "354": "IS",
    "355": "AL", "356": "MT", "357": "CY", "358": "FI", "359": "BG", "36": "HU", "370": "LT", "371": "LV", "372": "EE", "373": "MD", "374": "AM", "375": "BY", "376": "AD",
    "377": "MC", "378": "SM", "379": "VA", "380": "UA", "381": "RS", "382": "ME", "383": "XK", "385": "HR", "386": "SI", "387": "BA", "389": "MK", "39": "IT", "40": "RO",
    "41": "CH", "420": "CZ", "421": "SK", "423": "LI", "43": "AT", "44": "GB", "441481": "GG", "441534": "JE", "441624": "IM", "45": "DK", "46": "SE", "47": "NO",
    "4779": "SJ", "48": "PL", "49": "DE", "500": "FK", "501": "BZ", "502": "GT", "503": "SV", "504": "HN", "505": "NI", "506": "CR", "507": "PA", "508": "PM", "509": "HT",
    "51": "PE", "52": "MX", "53": "CU", "54": "AR", "55": "BR", "56": "CL", "57": "CO", "58": "VE", "590": "GP", "591": "BO", "592": "GY", "593": "EC", "594": "GF",
    "595": "PY", "596": "MQ", "597": "SR", "598": "UY", "599": "BQ", "5999": "CW", "60": "MY", "61": "AU", "62": "ID", "63": "PH", "64": "NZ", "65": "SG", "66": "TH",
    "670": "TL", "672": "NF", "673": "BN", "674": "NR", "675": "PG", "676": "TO", "677": "SB", "678": "VU", "679": "FJ", "680": "PW", "681": "WF", "682": "CK", "683": "NU",
    "685": "WS", "686": "KI", "687": "NC", "688": "TV", "689": "PF", "690": "TK", "691": "FM", "692": "MH", "81": "JP", "82": "KR", "84": "VN", "850": "KP", "852": "HK",
    "853": "MO", "855": "KH", "856": "LA", "86": "CN", "880": "BD", "886": "TW", "90": "TR", "91": "IN", "92": "PK", "93": "AF", "94": "LK", "95": "MM", "960": "MV",
    "961": "LB", "962": "JO", "963": "SY", "964": "IQ", "965": "KW", "966": "SA", "967": "YE", "968": "OM", "970": "PS", "971": "AE", "972": "IL", "973": "BH", "974": "QA",
    "975": "BT", "976": "MN", "977": "NP", "98": "IR", "992": "TJ", "993": "TM", "994": "AZ", "995": "GE", "996": "KG", "998": "UZ", "1204": "CA", "1226": "CA", "1236": "CA",
    "1249": "CA", "1250": "CA", "1257": "CA", "1263": "CA", "1289": "CA", "1306": "CA", "1343": "CA", "1354": "CA", "1365": "CA", "1367": "CA", "1368": "CA", "1382": "CA",
    "1403": "CA", "1416": "CA", "1418": "CA", "1428": "CA", "1431": "CA", "1437": "CA", "1438": "CA", "1450": "CA", "1460": "CA", "1468": "CA", "1474": "CA", "1506": "CA",
    "1514": "CA", "1519": "CA", "1548": "CA", "1579": "CA", "1581": "CA", "1584": "CA", "1587": "CA", "1604": "CA", "1613": "CA", "1639": "CA", "1647": "CA", "1672": "CA",
    "1683": "CA", "1705": "CA", "1709": "CA", "1742": "CA", "1753": "CA", "1778": "CA", "1780": "CA", "1782": "CA", "1807": "CA", "1819": "CA", "1825": "CA", "1867": "CA",
    "1873": "CA", "1879": "CA", "1902": "CA", "1905": "CA", "1942": "CA",
}
#: Endings of linked files worth keeping.
INTERESTING = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf", "csv", "txt", "xml", "json", "sql", "bak", "log", "zip", "gz", "tgz", "tar", "rar", "7z", "exe", "msi", "dmg", "iso", "apk", "env", "config", "ini", "yml", "yaml", "epub", "mobi", "kml", "kmz",
)
#: Where a page names a person: (pattern, confidence), the surer place first, and what a name looks like.
PERSON_PLACES = (
    (r"""(?i)<meta[^>]+(?:name|property)=["'](?:author|article:author|dc\.creator|twitter:creator)["'][^>]+content=["']([^"']+)["']""", 0.75),
    (r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+(?:name|property)=["'](?:author|article:author|dc\.creator)["']""", 0.75),
    (r"""(?i)"author"\s*:\s*(?:\{[^}]*?"name"\s*:\s*)?"([^"]+)\"""", 0.75),
    (r"""(?is)<a[^>]+rel=["']author["'][^>]*>(.*?)</a>""", 0.75),
)
BYLINE = r"\b[Bb]y[:\s]+((?:[A-Z][A-Za-z'’.\-]*\s+){1,3}[A-Z][A-Za-z'’.\-]+)"
PERSON = r"^(?:[A-Z][A-Za-z'’\-]+|[A-Z]\.?)(?:\s+(?:[A-Z][A-Za-z'’\-]+|[A-Z]\.?)){1,3}$"
NO_PERSONS = ("admin", "administrator", "editor", "staff", "team", "guest", "author", "unknown", "webmaster")


def cells(raw: DataFrame, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Cell towers ``radio,mcc,net,area,cell,lon,lat,range,samples``; headers and bad rows are rejects."""
    c = F.split(text, ",")
    n = lambda i: F.get(c, F.lit(i)).try_cast("bigint")
    rows = raw.select("*", F.get(c, F.lit(0)).alias("radio"), *[n(i + 1).alias(k) for i, k in enumerate(("mcc", "net", "area", "cell"))], finite(F.get(c, F.lit(5))).alias("lon"), finite(F.get(c, F.lit(6))).alias("lat"), n(7).alias("range"), n(8).alias("samples"))
    good = F.coalesce(F.col("mcc").isNotNull() & F.col("cell").isNotNull() & placed(F.col("lat"), F.col("lon")), F.lit(False))
    kept, rejects = split_good(rows, good, F.lit("bad id or position"), text)
    street = F.coalesce((F.col("samples") >= 5) & F.col("range").between(1, 1000), F.lit(False))
    return kept.select(F.concat_ws("-", "mcc", "net", "area", "cell").alias("key"), "radio", "lat", "lon", F.when(street, "street").otherwise("city").alias("precision"), "range", "samples"), rejects


def news(raw: DataFrame, text: str = "raw", least_mentions: int = 2) -> DataFrame:
    """News events ``id, root code, quad class, mentions, lat, lon, title`` by tabs; the first valid row of an id wins."""
    c = F.split(text, "\t")
    g = lambda i: F.get(c, F.lit(i))
    roots = F.create_map(*[F.lit(x) for kv in NEWS_ROOTS.items() for x in kv])
    rows = raw.select("line", g(0).try_cast("bigint").alias("id"), F.coalesce(roots[g(1)], F.lit("other")).alias("event"), g(2).try_cast("int").alias("quad"), g(3).try_cast("int").alias("mentions"), finite(g(4)).alias("lat"), finite(g(5)).alias("lon"), F.substring(g(6), 1, 200).alias("title"))
    valid = rows.where(F.col("id").isNotNull() & placed(F.col("lat"), F.col("lon")) & (F.col("mentions") >= least_mentions))
    return valid.groupBy("id").agg(F.min_by(F.struct("event", "quad", "mentions", "lat", "lon", "title"), "line").alias("r")).select("id", "r.*")


def element_sets(raw: DataFrame) -> DataFrame:
    """Satellite element sets of (file, line number, text) lines: a name line before lines 1 and 2 of one number;
    broken sets are skipped. Catalogue numbers may start with a letter (A is 10; I and O are left out)."""
    order = Window.partitionBy("file").orderBy("at")
    rows = raw.withColumn("one", F.lead("text", 1).over(order)).withColumn("two", F.lead("text", 2).over(order))
    number = lambda c: F.substring(c, 3, 5)
    good = F.startswith("one", F.lit("1 ")) & F.startswith("two", F.lit("2 ")) & ~F.col("text").rlike("^[12] ") & (F.length("one") >= 68) & (F.length("two") >= 68) & (number(F.col("one")) == number(F.col("two")))
    head, rest = F.substring("one", 3, 1), F.substring("one", 4, 4).try_cast("int")
    letters = F.instr(F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ"), head)
    norad = F.when(head.rlike("[A-Z]") & (letters > 0), (letters + 9) * 10_000 + rest).otherwise(F.trim(F.substring("one", 3, 5)).try_cast("int"))
    yy = F.substring("one", 19, 2).try_cast("int")
    return rows.where(good).select(
        norad.alias("norad_id"), F.trim("text").alias("name"), F.when(yy < 57, yy + 2000).otherwise(yy + 1900).alias("epoch_year"), F.substring("one", 21, 12).try_cast("double").alias("epoch_day"),
        F.trim(F.substring("two", 9, 8)).try_cast("double").alias("inclination"), F.trim(F.substring("two", 53, 11)).try_cast("double").alias("mean_motion"),
    ).withColumn("period_min", F.lit(1440.0) / F.col("mean_motion"))


def countries_mentioned(df: DataFrame, key: str, text: str) -> DataFrame:
    """Countries named in texts, longest names first, once each."""
    names = "|".join(re.escape(n) for n in sorted(COUNTRIES, key=len, reverse=True))
    codes = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    hits = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({names})(?![\p{{L}}\p{{N}}_])"), F.lit(1))).alias("name"))
    return hits.groupBy(key, codes[F.col("name")].alias("country")).agg(F.count("*").alias("mentions"))


def phone_country(number: Column) -> Column:
    """Country of an international number by its longest calling code."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    codes = F.create_map(*[F.lit(x) for kv in CALLING_CODES.items() for x in kv])
    return F.coalesce(*[codes[F.substring(digits, 1, n)] for n in sorted({len(c) for c in CALLING_CODES}, reverse=True)])


def persons(df: DataFrame, key: str, text: str, byline: str = BYLINE) -> DataFrame:
    """Names of persons in author tags and bylines, once each; the surest place gives the confidence.

    The group of ``byline`` is the name that a byline gives, of two to four words unless told otherwise.
    """
    places = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(sure).alias("confidence"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)).alias("names")) for rank, (p, sure) in enumerate((*PERSON_PLACES, (byline, 0.55)))])
    rows = df.select(key, F.explode(places).alias("p")).select(key, "p.rank", "p.confidence", F.posexplode("p.names").alias("at", "name"))
    plain = F.regexp_replace(F.regexp_replace("name", "<[^>]*>", " "), r"\s+", " ")
    named = rows.withColumn("name", F.regexp_replace(plain, r"^[ .,\-@]+|[ .,\-@]+$", ""))
    kept = named.where(F.col("name").rlike(PERSON) & ~F.lower("name").isin(*NO_PERSONS) & ~F.lower("name").contains("http"))
    best = kept.groupBy(key, F.lower("name").alias("_n")).agg(F.min_by(F.struct("name", "confidence"), F.struct("rank", "at")).alias("p"))
    return best.select(key, "p.name", "p.confidence")


def printable_runs(df: DataFrame, key: str, content: str, least: int = 4) -> DataFrame:
    """Runs of printable ASCII in binary content, once each, with the place of the first."""
    runs = F.regexp_extract_all(F.decode(F.col(content), "ISO-8859-1"), F.lit(rf"([\x20-\x7E]{{{least},}})"), F.lit(1))
    return df.select(key, F.posexplode(runs).alias("at", "run")).groupBy(key, "run").agg(F.min("at").alias("at"))


def linked_files(links: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` links of a page to documents and archives."""
    ext = F.lower(F.regexp_extract("target", r"\.([A-Za-z0-9]{1,6})(?:[?#].*)?$", 1))
    rows = links.where(ext.isin(*INTERESTING)).groupBy("page_id", "target").agg(F.min("place").alias("place"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("place"))).where(F.col("n") <= most).select("page_id", "target")


def onions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Onion addresses, also inside url-encoded parameters."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "%3A", ":"), "%2F", "/")
    return df.select(key, F.explode(F.regexp_extract_all(plain, F.lit(r"(https?://[a-z2-7]{16,56}\.onion)"), F.lit(1))).alias("onion")).distinct()


def pipeline(content: DataFrame, extractors: list, depth: int = 2) -> DataFrame:
    """Findings (parent, type, value, depth) of all extractors, fed back to them ``depth`` times.

    Values that were scanned before aren't scanned again; each (parent, type, value) is one finding.
    """
    frontier = content.select(F.col("id").alias("parent"), "text")
    done, out = None, None
    for level in range(1, depth + 1):
        hits = None
        for extract in extractors:
            rows = extract(frontier)
            hits = rows if hits is None else hits.union(rows)
        hits = hits.distinct().withColumn("depth", F.lit(level))
        out = hits if out is None else out.union(hits)
        fresh = hits.select(F.col("value").alias("parent"), F.col("value").alias("text")).distinct()
        done = fresh.select("parent") if done is None else done
        frontier = fresh if level == 1 else fresh.join(done, "parent", "left_anti")
    return out.groupBy("parent", "type", "value").agg(F.min("depth").alias("depth"))


def relays(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Relays of a directory: role by flags, addresses without ports, city position or none."""
    schema = "relays array<struct<fingerprint string, flags array<string>, or_addresses array<string>, country string, latitude double, longitude double>>"
    rows = raw.select(F.explode(F.from_json(text, schema)["relays"]).alias("r")).select("r.*")
    role = F.when(F.array_contains("flags", "Exit"), "exit").when(F.array_contains("flags", "Guard"), "guard").when(F.array_contains("flags", "Authority"), "authority").otherwise("middle")
    ips = F.transform("or_addresses", lambda a: F.regexp_replace(F.regexp_replace(a, r":[0-9]+$", ""), r"[\[\]]", ""))
    return rows.select(F.concat(F.lit("tor:"), "fingerprint").alias("key"), role.alias("role"), F.array_join(ips, ",").alias("addresses"), "country", F.when(F.col("latitude").isNotNull(), "city").otherwise("country").alias("precision"))


def geo_records(raw: DataFrame) -> DataFrame:
    """Geolocation records (iso, lat, lon, radius_km, asn, age_days) held to their rules."""
    ok = placed(F.col("lat"), F.col("lon"))
    precision = F.when(~ok, None).when(F.col("radius_km") > 150, "country").when(F.col("radius_km") > 15, "region").otherwise("city")
    return raw.select("target", F.when(F.col("iso").rlike("^[A-Za-z]{2}$"), F.upper("iso")).alias("country"), F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lon")).alias("lon"), precision.alias("precision"), F.when(F.col("asn").between(1, 2**32 - 1), F.col("asn")).alias("asn"), (F.col("age_days") > 45).alias("stale"))


def resolved(entities: DataFrame, hosts: DataFrame, networks: DataFrame, centroids: DataFrame) -> DataFrame:
    """Position of entities (id, strategy, lat, lon, key) by their strategy: their own, that of their address' region,
    or a country centroid; the precision says which, and without any the position is null."""
    via_ip = hosts.join(networks, "ip").select(F.col("host").alias("key"), F.col("region").alias("net_region"))
    found_ = entities.join(via_ip, "key", "left").withColumn("at", F.when(F.col("strategy") == "via_ip", F.col("net_region")).when(F.col("strategy") == "via_region", F.col("region")))
    placed_ = found_.join(centroids.select(F.col("region").alias("at"), "clat", "clon"), "at", "left")
    direct = F.col("strategy") == "direct"
    fix = F.when(direct & F.col("lat").isNotNull(), "exact").when(F.col("clat").isNotNull(), F.when(F.col("strategy") == "via_ip", "region").otherwise("country"))
    return placed_.select("id", "strategy", F.when(direct, F.col("lat")).otherwise(F.col("clat")).alias("lat"), F.when(direct, F.col("lon")).otherwise(F.col("clon")).alias("lon"), fix.alias("precision"))


def since_seconds(text: Column) -> Column:
    """Seconds of the query times 24h, 3mo and 2y; null for others."""
    unit = F.regexp_extract(text, r"^[0-9]+(s|m|h|d|w|mo|y)$", 1)
    factor = F.coalesce(*[F.when(unit == u, s) for u, s in (("s", 1), ("m", 60), ("h", 3600), ("d", 86_400), ("w", 604_800), ("mo", 2_592_000), ("y", 31_536_000))])
    return F.regexp_extract(text, r"^([0-9]+)", 1).try_cast("bigint") * factor


def run_verdict(cards: DataFrame) -> DataFrame:
    """Verdict of a run over all its feed scorecards with the reasons, in fixed order."""
    return cards.agg(
        F.when(F.max((F.col("verdict") == "FAIL").cast("int")) == 1, "FAIL").when(F.max((F.col("verdict") == "WARN").cast("int")) == 1, "WARN").otherwise("PASS").alias("verdict"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("verdict").isin("FAIL", "WARN"), F.concat_ws(" ", "module", "verdict")))), ";").alias("reasons"), F.count("*").alias("feeds"),
    )


def scope_allowed(targets: DataFrame, networks: DataFrame, scopes: DataFrame) -> DataFrame:
    """Targets (target, host, ip, ip_num) inside an allowed network or below an allowed host."""
    from .matching import host_suffixes, in_networks

    by_ip = in_networks(targets.where("ip_num is not null"), networks).select("target")
    by_host = host_suffixes(targets.where("host is not null")).join(scopes.select(F.col("scope").alias("suffix")).distinct(), "suffix", "left_semi").select("target")
    return targets.join(by_ip.union(by_host).distinct(), "target", "left_semi")
