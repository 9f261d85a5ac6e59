"""Queries of web and registry intelligence; observations are written from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import webintel as w
from ..sources import bindings as b
from .registry import query, sql

_HEADERS = """headers as (select page_id, name, value from (select page_id, unnest(['Content-Type', 'X-Backend', 'Server', 'X-Debug-Token', 'X-Request-Id', 'Date', 'Via']) as name,
    unnest(['text/html', '10.0.' || page_id % 250 || '.1', case when page_id % 2 = 0 then 'nginx/1.' || page_id % 20 || ' PHP/8.1' else 'Apache' end, 'ab' || page_id, page_id::varchar, 'today', 'proxy.corp']) as value from pages))"""


def headers(spark, sf):
    pairs = {
        "Content-Type": "'text/html'", "X-Backend": "concat('10.0.', page_id % 250, '.1')", "Server": "if(page_id % 2 = 0, concat('nginx/1.', page_id % 20, ' PHP/8.1'), 'Apache')",
        "X-Debug-Token": "concat('ab', page_id)", "X-Request-Id": "cast(page_id as string)", "Date": "'today'", "Via": "'proxy.corp'",
    }
    return b.load(spark, sf, "pages").select("page_id", F.explode(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.expr(v))])).alias("name", "value"))


@query("c8_header_classes", f"with {_HEADERS} select page_id, name, value, case name when 'Content-Type' then 'none' when 'X-Backend' then 'leak' when 'Server' then case when page_id % 2 = 0 then 'version' else 'backend' end when 'X-Debug-Token' then 'debug' when 'X-Request-Id' then 'trace' when 'Via' then 'leak' else 'other' end as class from headers")
def classes(spark, sf):
    return w.header_class(headers(spark, sf))


@query("c26_header_inventory", f"with {_HEADERS} select distinct page_id, name || ': ' || value as header from headers where name <> 'Date'")
def inventory(spark, sf):
    return w.header_inventory(headers(spark, sf))


@query("c10_server_products", f"with {_HEADERS}, t as (select page_id, unnest(regexp_extract_all(value, '([A-Za-z][A-Za-z._-]+(?:/[0-9][0-9A-Za-z.-]*)?)', 1)) as t from headers where name = 'Server') select distinct page_id, split_part(t, '/', 1) as product, case when contains(t, '/') then split_part(t, '/', 2) end as version from t")
def products(spark, sf):
    return w.products(headers(spark, sf).where("name = 'Server'"))


@query("c9_cookie_software", """select page_id, ['PHPSESSID', 'wordpress_logged_in', 'JSESSIONID', '_ga_X', 'other'][(page_id % 5)::int + 1] as name, ['PHP', 'WordPress', 'Java', 'Analytics', null][(page_id % 5)::int + 1] as software from pages""")
def cookies(spark, sf):
    rows = b.load(spark, sf, "pages").selectExpr("page_id", "concat(element_at(array('PHPSESSID', 'wordpress_logged_in', 'JSESSIONID', '_ga_X', 'other'), cast(page_id % 5 as int) + 1), '=', page_id, '; Path=/') as cookie")
    return w.cookie_software(rows)


@query("c14_certificates", sql("""select page_id, host, array_to_string(list_filter([case when after < 1705000000 then 'expired' end, case when before > 1705000000 then 'not yet valid' end, case when after between 1705000000 and 1705000000 + 2592000 then 'expiring soon' end,
    case when page_id % 6 = 0 then 'self-signed' end, case when after - before > 398 * 86400 then 'long-lived' end, case when page_id % 4 = 3 then 'host mismatch' end], lambda v: v is not null), ',') as issues
    from (select *, 1705000000 - 40000000 + page_id * 200000 as before, 1705000000 - 20000000 + page_id * 120000 as after from page_hosts)""", "page_hosts"))
def certificates(spark, sf):
    certs = b.page_hosts(spark, sf).selectExpr(
        "page_id", "host", "concat('cn', page_id) as subject", "if(page_id % 6 = 0, concat('cn', page_id), 'ca') as issuer", "1705000000 - 40000000 + page_id * 200000 as not_before", "1705000000 - 20000000 + page_id * 120000 as not_after",
        "case page_id % 4 when 3 then array('elsewhere.test') when 2 then array(concat('*', substr(host, instr(host, '.')))) else array('x.test', host) end as names",
    )
    return w.certificates(certs, 1_705_000_000).select("page_id", "host", F.array_join("issues", ",").alias("issues"))


_SERVICES = {  # a name at the service, what its page says, and whether a missing name is enough
    0: ("x{}.github.io", "There isn''t a GitHub Pages site here.", False), 1: ("b{}.s3.amazonaws.com", "<Code>NoSuchBucket</Code>", False), 2: ("a{}.herokuapp.com", "", True),
    3: ("f{}.global.ssl.fastly.net", "Fastly error: unknown domain: x", False), 4: ("r{}.bitbucket.io", "", True), 5: ("s{}.myshopify.com", "Sorry, this shop is currently unavailable.", False), 6: ("docs{}.readthedocs.io", "", True),
}


def _case(values: dict, other: str) -> str:
    return "case page_id % 9 " + " ".join(f"when {k} then {v}" for k, v in values.items()) + f" else {other} end"


@query("c15_takeovers", sql("""select page_id, host, case when page_id % 9 in (2, 4, 6) then 0.9::double else 0.95::double end as confidence from page_hosts where page_id % 9 <= 6 and page_id % 4 > 0""", "page_hosts"))
def takeovers(spark, sf):
    cname = _case({k: "concat('" + n.replace("{}", "', page_id, '") + "')" for k, (n, _, _) in _SERVICES.items()}, "concat('x', page_id, '.safe.test')")
    body = _case({k: f"'{t}'" for k, (_, t, _) in _SERVICES.items() if t}, "'<Code>NoSuchBucket</Code>'")
    names = b.page_hosts(spark, sf).selectExpr("page_id", "host", f"{cname} as cname", "page_id % 4 > 0 and page_id % 9 in (2, 4, 6, 7) as missing", f"if(page_id % 4 = 0, 'hello', {body}) as body")
    return w.takeovers(names).select("page_id", "host", "confidence")


@query("c16_bucket_states", """select page_id, case page_id % 4 when 0 then 'missing' when 1 then 'private' when 2 then 'public' else 'unknown' end as state, case when page_id % 4 = 2 then 'a' || page_id || ',b' else '' end as keys from pages""")
def bucket_states(spark, sf):
    answers = b.load(spark, sf, "pages").selectExpr("page_id", "element_at(array(404, 403, 200, 500), cast(page_id % 4 as int) + 1) as status", "concat('<ListBucketResult><Key>a', page_id, '</Key><Key>b</Key></ListBucketResult>') as body")
    return w.bucket_state(answers).select("page_id", "state", F.array_join("keys", ",").alias("keys"))


@query("c13_robots", sql("""with h as (select distinct host from page_hosts), p as (select distinct host, '/' || ['private/x', 'private/open/y', 'public', 'p'][(page_id % 4)::int + 1] as path from page_hosts)
    select host, path, not (starts_with(path, '/private') and not starts_with(path, '/private/open')) as allowed from p""", "page_hosts"))
def robots(spark, sf):
    hosts = b.page_hosts(spark, sf)
    files = hosts.select("host").distinct().withColumn("robots", F.lit("User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow:\n"))
    paths = hosts.selectExpr("host", "concat('/', element_at(array('private/x', 'private/open/y', 'public', 'p'), cast(page_id % 4 as int) + 1)) as path").distinct()
    return w.robots_verdicts(paths, w.robots_rules(files))


@query("c18_e19_dns_filter", sql("""select 'h' || page_id || '.' || host as host, case page_id % 4 when 0 then 'blocked' when 1 then 'sinkhole' when 2 then 'open' else 'unknown' end as verdict from page_hosts where page_id % 5 > 0""", "page_hosts"))
def dns(spark, sf):
    hosts = b.page_hosts(spark, sf)
    ref = hosts.selectExpr("concat('h', page_id, '.', host) as host", "if(page_id % 5 = 0, 'NXDOMAIN', 'NOERROR') as rcode")
    got = hosts.where("page_id % 4 < 3").selectExpr("concat('h', page_id, '.', host) as host", "if(page_id % 4 = 0, 'REFUSED', 'NOERROR') as rcode", "if(page_id % 4 = 1, '0.0.0.0', '10.1.1.1') as ip")
    return w.filtered_names(ref, got)


@query("c19_blocklist_codes", "select c_custkey as target, case c_custkey % 12 when 2 then 'spam' when 3 then 'spam' when 4 then 'exploit' when 9 then 'hijacked' when 10 then 'policy' else 'listed' end as meaning from customer where c_custkey % 13 > 0")
def codes(spark, sf):
    return w.blocklist_meanings(b.load(spark, sf, "customer").selectExpr("c_custkey as target", "if(c_custkey % 13 = 0, '127.255.255.254', concat('127.0.0.', c_custkey % 12)) as answer"))


@query("c20_wildcards", sql("select host as domain, 'h' || page_id || '.' || host as host from page_hosts where page_id % 3 <> 0", "page_hosts"))
def wildcards(spark, sf):
    h = b.page_hosts(spark, sf)
    hosts = h.selectExpr("host as domain", "concat('h', page_id, '.', host) as host", "case page_id % 3 when 0 then array('1.1.1.1') when 1 then array('1.1.1.1', '9.9.9.9') else array('8.8.8.8') end as ips")
    return w.without_wildcards(hosts, h.select(F.col("host").alias("domain")).distinct().withColumn("wild", F.array(F.lit("1.1.1.1"), F.lit("2.2.2.2"))))


_MARKED = "marked as (select page_id, html || '<script src=\"https://cdn.example.com/jquery-3.' || page_id % 7 || '.1.js\"></script><a href=\"https://github.com/User' || page_id || '\">me</a>UA-12345' || page_id || '-1 GTM-ABC' || page_id % 10 || 'Z <img src=\"/logo.png\">' as html from pages)"


def marked(spark, sf):
    tail = F.expr("concat('<script src=\"https://cdn.example.com/jquery-3.', page_id % 7, '.1.js\"></script><a href=\"https://github.com/User', page_id, '\">me</a>UA-12345', page_id, '-1 GTM-ABC', page_id % 10, 'Z <img src=\"/logo.png\">')")
    return b.load(spark, sf, "pages").select("page_id", F.concat("html", tail).alias("html"))


#: What the queries of identifiers, profiles and products append to a page, for both dialects: pieces of text, or expressions of page_id.
_SIGNS = (
    "<p>UA-12345", "page_id", "-1 GTM-ABC", "page_id % 10", "Z G-TAG", "100 + page_id % 900", " pub-1234567890", "100000 + page_id % 1000", " AW-", "100000000 + page_id", "<script>hjid:", "10000 + page_id",
    ", ym(", "1000000 + page_id", ', x) ttq.load("CODEABCDEFGHIJK', "page_id % 7", '")</script><a href="https://github.com/User', "page_id", '">me</a> <a href="https://x.com/Ann', "page_id",
    '"> <a href="https://www.instagram.com/Pic.', "page_id", '"> <a href="https://t.me/tg_', "page_id", '"> <a href="https://www.linkedin.com/in/Li-', "page_id", '"> <a href="https://www.youtube.com/@Tube', "page_id",
    '"> <i src="https://cdn.example.com/jquery-3.', "page_id % 7", '.1.js"></i> /wp-content/ WordPress 6.', "page_id % 9", " /_next/static/ /sites/default/files cdn.shopify.com /_nuxt/app",
)


def _written(text: str) -> str:
    """The pieces joined, as an expression; ``text`` is the dialect's type of strings."""
    return " || ".join(f"cast({x} as {text})" if "page_id" in x else f"'{x}'" for x in _SIGNS)


def signed(spark, sf):
    return b.load(spark, sf, "pages").selectExpr("page_id", f"html || {_written('string')} as html")


_SIGNED = f"signed as (select page_id, html, html || {_written('varchar')} as whole from pages)"
#: Written for these pages alone, apart from the operators' patterns.
_OWN_IDS = {"ga": "UA-[0-9]+-[0-9]+", "gtm": "GTM-[A-Z0-9]+", "ga4": "G-TAG[0-9]+", "adsense": "pub-[0-9]+", "ads": "AW-[0-9]+", "hotjar": "hjid:([0-9]+)", "yandex_metrika": "ym.([0-9]+),", "tiktok_pixel": "CODE[A-K0-9]+"}
_OWN_USERS = {"github": "github.com/([A-Za-z0-9]+)", "twitter": "/x.com/([A-Za-z0-9]+)", "instagram": "instagram.com/([A-Za-z0-9.]+)", "telegram": "t.me/([a-z0-9_]+)", "linkedin": "linkedin.com/in/([A-Za-z0-9-]+)", "youtube": "youtube.com/@([A-Za-z0-9]+)"}


def _each(name: str, value: str, patterns: dict, wrap: str = "{}") -> str:
    one = lambda k, p: f"select distinct page_id, '{k}' as {name}, {wrap.format(f'unnest(regexp_extract_all(whole, {chr(39)}{p}{chr(39)}, {int(chr(40) in p)}))')} as {value} from signed"
    return " union all ".join(one(k, p) for k, p in patterns.items())


@query("d6_analytics_ids", f"with {_SIGNED} {_each('provider', 'id', _OWN_IDS)}")
def analytics(spark, sf):
    return w.analytics_ids(signed(spark, sf))


@query("d7_profiles", f"with {_SIGNED} {_each('site', 'username', _OWN_USERS, 'lower({})')}")
def profiles(spark, sf):
    return w.profiles(signed(spark, sf), "page_id", "html")


@query("d9_frameworks", f"""with {_SIGNED}, p as (select page_id, html, unnest(['WordPress', 'jQuery', 'Next.js', 'Drupal', 'Shopify', 'Nuxt.js']) as product, unnest(['6.' || page_id % 9, null, null, null, null, null]) as told from signed),
    own as (select distinct page_id, case m when 'data-reactroot' then 'React' else 'Bootstrap' end as product, html from (select page_id, html, unnest(regexp_extract_all(html, 'data-reactroot|bootstrap')) as m from signed))
    select page_id, product, case when product = 'jQuery' then nullif(regexp_extract(html || 'jquery-3.' || page_id % 7 || '.1.js', 'jquery[.-]?([0-9.]*)', 1), '') else told end as version from p
    union all select page_id, product, case when product = 'Bootstrap' then nullif(regexp_extract(html, 'bootstrap[.-]?([0-9.]*)', 1), '') end from own""")
def frameworks(spark, sf):
    return w.frameworks(signed(spark, sf))


@query("d15_sub_resources", f"""with {_MARKED}, r as (select page_id, 'script' as kind, unnest(regexp_extract_all(html, '<script[^>]*\\ssrc="([^"]*)"', 1)) as target from marked union all select page_id, 'image', unnest(regexp_extract_all(html, '<img[^>]*\\ssrc="([^"]*)"', 1)) from marked
    union all select page_id, 'frame', unnest(regexp_extract_all(html, '<iframe[^>]*\\ssrc="([^"]*)"', 1)) from marked union all select page_id, 'stylesheet', unnest(regexp_extract_all(html, '<link[^>]*rel="stylesheet"[^>]*href="([^"]*)"', 1)) from marked) select distinct * from r""")
def resources(spark, sf):
    return w.sub_resources(marked(spark, sf))


@query("e25_filter_rules", f"""with {_MARKED}, r as (select page_id, 'script' as kind, unnest(regexp_extract_all(html, '<script[^>]*\\ssrc="([^"]*)"', 1)) as target from marked) select distinct page_id, kind, target from r where starts_with(target, 'https://cdn.example.com/')""")
def rules(spark, sf):
    listed = b.page_hosts(spark, sf).selectExpr("if(page_id % 2 = 0, 'example.com', 'other.test') as host", "if(page_id % 2 = 0, 'script', null) as kind").distinct()
    return w.blocked(w.sub_resources(marked(spark, sf)), listed)


_FAULTS = (  # kind, what a text ends with, the message it holds
    ("python", "Traceback (most recent call last):", ""), ("php", "Fatal error: Call to x() in /a.php", ""), ("sql", "You have an error in your SQL syntax", ""), ("oracle", "ORA-00942: no table", "ORA-00942"), ("postgresql", "PostgreSQL query failed", ""),
    ("sqlite", "sqlite3.OperationalError", ""), ("odbc", "ODBC Driver", ""), ("ruby", "(NoMethodError)", ""), ("php", "Warning: mysql_query() in /a.php on line 3", "Warning: mysql_query() in /a.php"), ("asp.net", "Server Error in '/' Application", ""),
)
_PICK = "[" + ", ".join("'{}'" for _ in _FAULTS) + "][(doc_id % 10)::int + 1]"


@query("d8_error_strings", f"""select doc_id, {_PICK.format(*[k for k, _, _ in _FAULTS])} as kind, {_PICK.format(*[(m or t).replace("'", "''") for _, t, m in _FAULTS])} as message from documents""")
def errors(spark, sf):
    ends = ", ".join('"' + t + '"' for _, t, _ in _FAULTS)
    return w.error_strings(b.load(spark, sf, "documents").selectExpr("doc_id", f"concat(text, '\n', element_at(array({ends}), cast(doc_id % 10 as int) + 1), '\n') as text"), "doc_id", "text")


@query("a21_whois_fields", sql("""select 'd' || page_id || '.' || host as domain, unnest(['registrar', 'name server', 'country']) as key, unnest(['Reg ' || page_id % 5, 'ns1.' || host || ';ns2.' || host, 'US']) as values from page_hosts""", "page_hosts"))
def whois(spark, sf):
    texts = b.page_hosts(spark, sf).selectExpr("concat('d', page_id, '.', host) as domain", "concat('Registrar: Reg ', page_id % 5, '\nName Server: ns2.', host, '\nName Server: ns1.', host, '\nRegistrant: REDACTED FOR PRIVACY\nnonsense\nCountry: US\nFax:\n') as text")
    return w.whois(texts)


@query("a22_open_ports", sql("""select ip as host, (target % 60000 + 1)::int as port, case when target % 2 = 0 then 'tcp' else 'udp' end as proto, 'http' as service, case when target % 3 > 0 then 'nginx 1.' || target % 9 end as software from addresses where target % 5 > 0""", "addresses"))
def ports(spark, sf):
    lines = b.addresses(spark, sf).selectExpr("concat(ip, ' ', target % 60000 + 1, '/', if(target % 2 = 0, 'tcp', 'udp'), ' ', if(target % 5 = 0, 'closed', 'open'), ' http', if(target % 3 > 0, concat(' nginx 1.', target % 9), '')) as line")
    return w.open_ports(lines)


@query("a23_response_mapper", sql("""select ip, 'malware' as label, 'fam' || (target * k) % 7 as value, round(least(0.95, 0.5 + ((target * k) % 100) / 200::double), 3) as confidence from addresses, (select unnest([1, 2, 3]) as k) where target % 4 >= k""", "addresses"))
def mapper(spark, sf):
    entry = "transform(filter(array(1, 2, 3), k -> target % 4 >= k), k -> named_struct('family', concat('fam', (target * k) % 7), 'level', (target * k) % 100))"
    raw = b.addresses(spark, sf).selectExpr("to_json(named_struct('query', ip, 'data', " + entry + ")) as raw")
    return w.mapped(raw, "query string, data array<struct<family string, level bigint>>", "r.data", {"ip": "r.query", "label": "'malware'", "value": "x.family", "confidence": "round(least(0.95D, 0.5D + x.level / 200D), 3)"})


@query("a18_passive_dns", sql("""select 'r' || target as rrname, kind, case kind when 'hostname' then 'r' || target else ip end as value from addresses, (select unnest(['hostname', 'ip']) as kind) where kind = 'hostname' or target % 2 = 0""", "addresses"))
def passive_dns(spark, sf):
    raw = b.addresses(spark, sf).selectExpr("to_json(named_struct('rrname', concat('r', target, '.'), 'rrtype', if(target % 2 = 0, 'A', 'TXT'), 'rdata', ip)) as raw")
    rows = raw.select(F.from_json("raw", "rrname string, rrtype string, rdata string").alias("r")).select("r.*").withColumn("rrname", F.regexp_replace("rrname", r"\.$", ""))
    emitted = F.array_compact(F.array(F.struct(F.lit("hostname").alias("kind"), F.col("rrname").alias("value")), F.when(F.col("rrtype").isin("A", "AAAA"), F.struct(F.lit("ip").alias("kind"), F.col("rdata").alias("value")))))
    return rows.select("rrname", F.explode(emitted).alias("e")).select("rrname", "e.*")


@query("a19_certificate_names", sql("""select distinct host as domain, n as name from page_hosts, lateral (select unnest([host, 'www.' || host, 'm' || page_id % 5 || '.' || host]) as n)""", "page_hosts"))
def cert_names(spark, sf):
    rows = b.page_hosts(spark, sf).selectExpr("host as domain", "concat('*.', host, '\nwww.', host, '\nm', page_id % 5, '.', host, '\nelsewhere.test') as name_value")
    names = rows.select("domain", F.explode(F.split("name_value", "\n")).alias("name")).withColumn("name", F.regexp_replace("name", r"^\*\.", ""))
    return names.where((F.col("name") == F.col("domain")) | F.endswith("name", F.concat(F.lit("."), "domain"))).distinct()


@query("a16_provider_ranges", sql("""select n as network, provider, region from (select concat_ws('.', lo // 16777216, lo // 65536 % 256, lo // 256 % 256, lo % 256) || '/' || prefix_len as n, provider, 'r' || region as region, row_number() over () as x from networks) """, "networks"))
def ranges(spark, sf):
    from ..operators.matching import dotted

    page = F.expr("cast(substring_index(provider, '#', -1) as long) div 500")  # a published document lists 500 ranges at most
    n = b.networks(spark, sf).select(F.concat_ws("/", dotted("lo"), "prefix_len").alias("cidr"), "provider", "region", page.alias("page"))
    lines = n.groupBy("region", "page").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("cidr").alias("ip_prefix"), F.concat(F.lit("r"), "region").alias("region"), F.col("provider").alias("service"))).alias("prefixes"))).alias("raw"))
    return w.mapped(lines, "prefixes array<struct<ip_prefix string, region string, service string>>", "r.prefixes", {"network": "x.ip_prefix", "provider": "x.service", "region": "x.region"})
