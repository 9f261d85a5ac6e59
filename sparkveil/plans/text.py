"""Queries of extraction and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as x
from ..sources import bindings as b
from .registry import query, sql

#: The documents with literals that bring identifiers the synthetic prose lacks.
_AUGMENTED = """select doc_id, text || case doc_id % 6 when 0 then ' mail Admin@Example.com or root@example.org now' when 1 then ' see https://example.com/a?b=1). and CVE-2024-1234 twice CVE-2024-1234'
    when 2 then ' Contact Acme Widgets Ltd and Blue Sky GmbH today' when 3 then ' wallet 0x52908400098527886E0F7030069857D2E4169EE7 and aa:BB:cc:11:22:33' when 4 then ' data SGVsbG8gd29ybGQsIGhlbGxvIHNwYXJr GB82WEST12345698765432'
    else ' card 4111 1111 1111 1111 and 10.1.2.3' end as text from documents"""


def augmented(spark, sf):
    tail = F.expr("""case doc_id % 6 when 0 then ' mail Admin@Example.com or root@example.org now' when 1 then ' see https://example.com/a?b=1). and CVE-2024-1234 twice CVE-2024-1234'
        when 2 then ' Contact Acme Widgets Ltd and Blue Sky GmbH today' when 3 then ' wallet 0x52908400098527886E0F7030069857D2E4169EE7 and aa:BB:cc:11:22:33' when 4 then ' data SGVsbG8gd29ybGQsIGhlbGxvIHNwYXJr GB82WEST12345698765432'
        else ' card 4111 1111 1111 1111 and 10.1.2.3' end""")
    return b.load(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def _hits(patterns: dict[str, str], table: str) -> str:
    return " union all ".join(f"select doc_id, '{k}' as type, unnest(regexp_extract_all(text, '({p.replace(chr(39), chr(39) * 2)})', 1)) as raw from {table}" for k, p in patterns.items())


_NORMAL = """case when type in ('email', 'hash', 'eth') then lower(raw) when type = 'iban' then upper(raw) when type = 'mac' then lower(raw) when type = 'cve' then upper(raw)
    when type = 'url' then regexp_replace(raw, '[.,;:)\\]]+$', '') else raw end"""


@query("d1_scan", f"with a as ({_AUGMENTED}), h as ({_hits(x.PATTERNS, 'a')}) select doc_id, type, {_NORMAL} as value, count(*) as mentions from h group by 1, 2, 3")
def scan(spark, sf):
    return x.scan(augmented(spark, sf), "doc_id")


def _thin(kind: str):
    @query(f"d2_{kind}", f"with a as ({_AUGMENTED}), h as ({_hits({kind: x.PATTERNS[kind]}, 'a')}) select doc_id, {_NORMAL} as value, count(*) as mentions from h group by 1, 2")
    def run(spark, sf):
        hits = x.found(augmented(spark, sf), kind, x.PATTERNS[kind], ["doc_id"], "text")
        return hits.groupBy("doc_id", x.normal_form(F.col("type"), F.col("raw")).alias("value")).agg(F.count("*").alias("mentions"))


for _kind in ("email", "hash", "iban", "eth"):
    _thin(_kind)

_LUHN = "list_sum(list_transform(range(len(digits)), lambda i: case when i % 2 = 1 then case when digits[len(digits) - i]::int * 2 > 9 then digits[len(digits) - i]::int * 2 - 9 else digits[len(digits) - i]::int * 2 end else digits[len(digits) - i]::int end)) % 10 = 0"


@query("d2_card", f"""with a as ({_AUGMENTED}), h as (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '({x.CARD})', 1)), '[ -]', '', 'g') as digits from a)
    select distinct doc_id, repeat('*', len(digits) - 4) || right(digits, 4) as card, sha256(digits) as fingerprint from h where len(digits) between 13 and 19 and {_LUHN}""")
def card(spark, sf):
    return x.cards(augmented(spark, sf), "doc_id")


@query("d4_companies", rf"""with a as ({_AUGMENTED}) select doc_id, lower(trim(raw)) as company, count(*) as mentions from (select doc_id, unnest(regexp_extract_all(text, '((?:(?:[A-Z][A-Za-z&]+ ){{1,5}})(?:Inc|Ltd|LLC|GmbH|Corp|PLC)\b)', 1)) as raw from a) group by 1, 2""")
def companies(spark, sf):
    return x.companies(augmented(spark, sf), "doc_id")


@query("d10_base64", f"""with a as ({_AUGMENTED}), h as (select doc_id, unnest(regexp_extract_all(text, '({x.BASE64})', 1)) as raw from a), d as (select doc_id, raw, try(decode(from_base64(raw))) as decoded from h where len(raw) % 4 = 0)
    select distinct doc_id, raw, decoded from d where len(decoded) >= 8 and regexp_matches(decoded, '^[\\x20-\\x7E]+$')""")
def base64(spark, sf):
    return x.base64_blobs(augmented(spark, sf), "doc_id")


_KIND = """case when lower(regexp_extract({h}, '\\.([A-Za-z0-9]{{1,5}})(?:[?#].*)?$', 1)) in ('css', 'js', 'png', 'jpg', 'jpeg', 'gif', 'svg', 'ico', 'woff') then 'asset'
    when lower(regexp_extract({h}, '\\.([A-Za-z0-9]{{1,5}})(?:[?#].*)?$', 1)) in ('pdf', 'doc', 'docx', 'xls', 'xlsx', 'zip', 'gz', 'tar', '7z', 'csv', 'txt') then 'file' else 'page' end"""


@query("d13_page_links", f"""select page_id, href, case when regexp_matches(href, '^[a-z]+://') then href when starts_with(href, '/') then root || href else root || '/' || href end as target, {_KIND.format(h='href')} as kind, place
    from (select page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) as root, h as href, (i - 1)::int as place from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from pages), lateral (select unnest(l) as h, unnest(range(1, len(l) + 1)) as i))""")
def links(spark, sf):
    return x.links(b.load(spark, sf, "pages"))


@query("d12_page_facts", """select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '') as title, nullif(trim(regexp_extract(html, '(?is)<meta[^>]*charset="?([A-Za-z0-9-]+)', 1)), '') as charset,
    len(regexp_extract_all(html, '(?i)<a '))::int as links, len(regexp_extract_all(html, '(?i)<script'))::int as scripts, len(regexp_extract_all(html, '(?i)<form'))::int as forms, len(regexp_extract_all(html, '<!--'))::int as comments,
    contains(lower(html), 'type="password"') as login from pages""")
def facts(spark, sf):
    return x.page_facts(b.load(spark, sf, "pages"))


@query("c1_classify", """with t as (select c_custkey as target, case c_custkey % 9 when 0 then 'user' || c_custkey || '@Example.com' when 1 then '10.0.' || c_custkey % 200 || '.7' when 2 then 'AS' || c_custkey when 3 then 'CVE-2023-' || (1000 + c_custkey)
    when 4 then '@name_' || c_custkey when 5 then '+4912345' || (10000 + c_custkey) when 6 then 'host' || c_custkey || '.example.org' when 7 then '10.0.0.0/' || c_custkey % 30 else '48.' || c_custkey % 90 || ', 2.35' end as token from customer)
    select target, token, k[1] as type, k[2]::double as confidence, case when k[1] = 'email' then lower(token) else token end as normalized from (select *, case c when 0 then ['email', '0.99'] when 1 then ['ip', '0.99'] when 2 then ['asn', '0.95'] when 3 then ['cve', '1.0']
    when 4 then ['username', '0.8'] when 5 then ['phone', '0.85'] when 6 then ['hostname', '0.8'] when 7 then ['cidr', '0.95'] else ['geo', '0.9'] end as k from (select *, target % 9 as c from t))""")
def classify(spark, sf):
    tokens = b.load(spark, sf, "customer").selectExpr("c_custkey as target", """case c_custkey % 9 when 0 then concat('user', c_custkey, '@Example.com') when 1 then concat('10.0.', c_custkey % 200, '.7') when 2 then concat('AS', c_custkey) when 3 then concat('CVE-2023-', 1000 + c_custkey)
        when 4 then concat('@name_', c_custkey) when 5 then concat('+4912345', 10000 + c_custkey) when 6 then concat('host', c_custkey, '.example.org') when 7 then concat('10.0.0.0/', c_custkey % 30) else concat('48.', c_custkey % 90, ', 2.35') end as token""")
    return x.classify(tokens, "token").select("target", "token", "type", "confidence", "normalized")


@query("c2_checksums", """with t as (select c_custkey as target, (4000000000000000 + c_custkey * 7919)::varchar as digits from customer),
    m as (select c_custkey as target, (c_custkey * 104729 + 3214282912345698765432161182)::hugeint as n from customer)
    select target, digits, """ + _LUHN + """ as luhn, ((111111 + target)::varchar || '131400')::bigint % 97 = 1 as iban_like, (((111111 + target)::varchar || '131400')::bigint % 97)::int as remainder from t""")
def checksums(spark, sf):
    t = b.load(spark, sf, "customer").selectExpr("c_custkey as target", "cast(4000000000000000 + c_custkey * 7919 as string) as digits", "concat('DE00', 111111 + c_custkey) as account")
    rest = x.mod97(F.col("account")).cast("int")
    return t.select("target", "digits", x.luhn(F.col("digits")).alias("luhn"), (rest == 1).alias("iban_like"), rest.alias("remainder"))


@query("c12_canonical_url", """with t as (select page_id, case page_id % 4 when 0 then upper(url) || '#top' when 1 then regexp_replace(url, '^[a-z]+://([^/]+)', 'HTTPS://\\1:443') when 2 then 'http://user:pw@host/x' else 'http://Host.Example:80' end as url from pages)
    select page_id, url, case when head <> '' and not contains(head, '@') then regexp_replace(regexp_replace(head, '^(http://[^/]*):80$', '\\1'), '^(https://[^/]*):443$', '\\1') || case when rest = '' then '/' else rest end end as canonical
    from (select *, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) as head, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) as rest from t)""")
def canonical(spark, sf):
    t = b.load(spark, sf, "pages").selectExpr("page_id", "case page_id % 4 when 0 then concat(upper(url), '#top') when 1 then regexp_replace(url, '^[a-z]+://([^/]+)', 'HTTPS://$1:443') when 2 then 'http://user:pw@host/x' else 'http://Host.Example:80' end as url")
    return t.select("page_id", "url", x.canonical_url(F.col("url")).alias("canonical"))


@query("c22_redaction", """select page_id, regexp_replace(url || '?q=1&Token=s3cret' || page_id || '&x=2', '(?i)([?&](?:key|token|apikey|secret|password)=)[^&#\\s''"]+', '\\1***', 'g') as redacted from pages""")
def redaction(spark, sf):
    t = b.load(spark, sf, "pages").select("page_id", F.expr("concat(url, '?q=1&Token=s3cret', page_id, '&x=2')").alias("u"))
    return t.select("page_id", x.redacted(F.col("u")).alias("redacted"))


@query("c28_durations", """select target, token, case when u <> '' then n * case u when 's' then 1 when 'm' then 60 when 'h' then 3600 when 'd' then 86400 else 604800 end when token = 'realtime' then 5 when token = 'daily' then 86400 when token = 'on_demand' then -1 else 3600 end::bigint as seconds
    from (select *, regexp_extract(token, '^[0-9]+([smhdw])$', 1) as u, try_cast(regexp_extract(token, '^([0-9]+)', 1) as bigint) as n from
    (select c_custkey as target, case c_custkey % 8 when 0 then 'daily' when 1 then 'realtime' when 2 then 'on_demand' when 3 then 'nonsense' else (c_custkey % 90) || substr('smhdw', (c_custkey % 5)::int + 1, 1) end as token from customer))""")
def durations(spark, sf):
    t = b.load(spark, sf, "customer").selectExpr("c_custkey as target", "case c_custkey % 8 when 0 then 'daily' when 1 then 'realtime' when 2 then 'on_demand' when 3 then 'nonsense' else concat(c_custkey % 90, substr('smhdw', cast(c_custkey % 5 as int) + 1, 1)) end as token")
    return t.select("target", "token", x.duration_seconds(F.col("token")).alias("seconds"))


@query("g10_email_hashes", f"with a as ({_AUGMENTED}), h as ({_hits({'email': x.PATTERNS['email']}, 'a')}) select distinct lower(trim(raw)) as email, md5(lower(trim(raw))) as md5, sha256(lower(trim(raw))) as sha256 from h")
def hashes(spark, sf):
    mails = x.found(augmented(spark, sf), "email", x.PATTERNS["email"], [], "text").select(F.lower(F.trim("raw")).alias("email")).distinct()
    return mails.select("email", F.md5("email").alias("md5"), F.sha2("email", 256).alias("sha256"))
