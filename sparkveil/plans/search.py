"""Queries of search and of the candidate generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generators as g, search as m, states as s
from ..sources import bindings as b
from .registry import query, sql

_DOCS = "docs as (select p_partkey as id, p_type as type, p_brand as value, p_name as label from part)"
_ASKED = "asked as (select s_suppkey as qid, case s_suppkey % 4 when 0 then 'Brand#' || (10 + s_suppkey % 50) when 1 then substr(p_name, 1, 5) when 2 then substr(p_name, 3, 6) else p_name end as q from supplier join part on p_partkey = s_suppkey)"


def docs(spark, sf):
    return b.load(spark, sf, "part").selectExpr("p_partkey as id", "p_type as type", "p_brand as value", "p_name as label")


def asked(spark, sf):
    both = b.load(spark, sf, "supplier").join(b.load(spark, sf, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    return both.selectExpr("s_suppkey as qid", "case s_suppkey % 4 when 0 then concat('Brand#', 10 + s_suppkey % 50) when 1 then substr(p_name, 1, 5) when 2 then substr(p_name, 3, 6) else p_name end as q")


@query("m1_query_parsing", """with q as (select c_custkey as qid, case c_custkey % 4 when 0 then 'type:ip "exact words" -tor ' || c_name when 1 then 'near:48.85,2.35,5km -5 alpha' when 2 then '-"left out" since:24h b' || c_custkey else 'plain words ' || c_custkey end as q from customer),
    t as (select qid, regexp_extract_all(q, '(-?"[^"]*"|\\S+)', 1) as l from q)
    select qid, len(list_filter(l, lambda t: regexp_matches(t, '^".*"$'))) ::int as phrases, array_to_string(list_transform(list_filter(l, lambda t: regexp_matches(t, '^-[^0-9]')), lambda t: replace(regexp_replace(t, '^-', ''), '"', '')), '|') as excluded,
    array_to_string(list_filter(l, lambda t: regexp_matches(t, '^(?:type|layer|source|since|until|near|limit):.+$')), '|') as filters,
    array_to_string(list_filter(l, lambda t: not regexp_matches(t, '^(?:type|layer|source|since|until|near|limit):.+$') and not regexp_matches(t, '^".*"$') and not regexp_matches(t, '^-[^0-9]')), '|') as terms from t""")
def parsing(spark, sf):
    q = b.load(spark, sf, "customer").selectExpr("c_custkey as qid", """case c_custkey % 4 when 0 then concat('type:ip "exact words" -tor ', c_name) when 1 then 'near:48.85,2.35,5km -5 alpha' when 2 then concat('-"left out" since:24h b', c_custkey) else concat('plain words ', c_custkey) end as q""")
    return m.parse(q).select("qid", F.size("phrases").alias("phrases"), *[F.array_join(c, "|").alias(c) for c in ("excluded", "filters", "terms")])


@query("m3_near_radius", """select c_custkey as qid, case c_custkey % 5 when 0 then 10000 when 1 then (c_custkey % 90) * 1000 when 2 then c_custkey % 90 when 3 then (c_custkey % 90) * 1609.344::double else (c_custkey % 90) * 1000 end::double as metres from customer""")
def radius(spark, sf):
    q = b.load(spark, sf, "customer").selectExpr("c_custkey as qid", "concat('1.5,-2.5', case c_custkey % 5 when 0 then '' when 1 then concat(',', c_custkey % 90, 'km') when 2 then concat(',', c_custkey % 90, 'm') when 3 then concat(',', c_custkey % 90, 'mi') else concat(',', c_custkey % 90) end) as q")
    return q.select("qid", m.near_metres(F.col("q")).alias("metres"))


@query("m5_exact_lookup", f"with {_DOCS}, {_ASKED} select qid, id, 1.0::double as score from asked join docs on lower(q) = lower(value)")
def exact(spark, sf):
    return m.exact(asked(spark, sf), docs(spark, sf))


@query("m6_tiered_match", f"""with {_DOCS}, {_ASKED}, h as (select distinct id, unnest([lower(value), lower(label)]) as h from docs)
    select qid, id, max(case when h = lower(q) then 1.0 when starts_with(h, lower(q)) then 0.8 else 0.5 end)::double as score from asked join h on contains(h, lower(q)) where len(q) >= 3 group by all""")
def tiers(spark, sf):
    return m.tiered(asked(spark, sf), docs(spark, sf))


@query("m7_typo_tolerant", r"""with docs as (select p_partkey as id, p_name as label from part), asked as (select s_suppkey as qid, substr(p_name, 1, 4) || 'x' || substr(p_name, 6) as q from supplier join part on p_partkey = s_suppkey),
    a as (select distinct qid, unnest(regexp_split_to_array(lower(q), '[\s.@/:_-]+')) as qw from asked), w as (select distinct id, unnest(regexp_split_to_array(lower(label), '[\s.@/:_-]+')) as w from docs)
    select distinct qid, id from a join w on len(qw) >= 4 and len(w) >= 3 and levenshtein(qw, w) <= case when len(qw) >= 8 then 2 else 1 end""")
def typos(spark, sf):
    both = b.load(spark, sf, "supplier").join(b.load(spark, sf, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    return m.fuzzy(both.selectExpr("s_suppkey as qid", "concat(substr(p_name, 1, 4), 'x', substr(p_name, 6)) as q"), docs(spark, sf))


_GRAMS = "list_distinct(list_transform(range(1, len({x}) + 2), lambda i: substr('  ' || lower({x}) || ' ', i, 3)))"


@query("m8_trigram_similarity", f"""with {_DOCS}, {_ASKED}, a as (select qid, len(g) as n, unnest(g) as g from (select qid, {_GRAMS.format(x='q')} as g from asked)), d as (select id, len(g) as m, unnest(g) as g from (select id, {_GRAMS.format(x='value')} as g from docs))
    select qid, id, round(k / (n + m - k), 6) as score from (select qid, id, n, m, count(*)::double as k from a join d using (g) group by all) where k / (n + m - k) >= 0.5""")
def trigrams(spark, sf):
    return m.similar(asked(spark, sf), docs(spark, sf))


@query("m9_merge_rank", f"""with {_DOCS}, {_ASKED}, h as (select distinct id, unnest([lower(value), lower(label)]) as h from docs),
    z as (select qid, id, 1.0::double as score from asked join docs on lower(q) = lower(value) union all select qid, id, round(max(case when h = lower(q) then 1.0 when starts_with(h, lower(q)) then 0.8 else 0.5 end)::double * 0.95, 4) from asked join h on contains(h, lower(q)) where len(q) >= 3 group by all),
    o as (select qid, id, max(score) as score from z group by all) select * from (select *, row_number() over (partition by qid order by score desc, id)::int as place from o) where place <= 20""")
def merged(spark, sf):
    return m.best(asked(spark, sf), docs(spark, sf), 20)


@query("m12_search_documents", sql("""select c_custkey as id, c_mktsegment as type, c_name as value, c_name as label, coalesce(degree, 0) as degree from customer left join (select src as node, count(*) as degree from relations group by src) on node = c_custkey""", "relations"))
def documents(spark, sf):
    entities = b.load(spark, sf, "customer").selectExpr("c_custkey as id", "c_mktsegment as type", "c_name as value", "c_name as label")
    return m.with_degree(entities, s.degrees(b.relations(spark, sf)))


_DOMAINS = "d as (select distinct 'brand' || lower(replace(substr(p_brand, 7), '#', '')) || '.com' as domain from part)"


def domains(spark, sf):
    return b.load(spark, sf, "part").selectExpr("concat('brand', lower(replace(substr(p_brand, 7), '#', '')), '.com') as domain").distinct()


#: The tables of the look-alikes as the SQL has them: suffixes, neighbours on the keyboard, like-looking glyphs.
_SUFFIXES = "com net org info biz co io app dev xyz online site shop store us uk eu de cn ru top live cc me"
_KEYS = "1:2q 2:1qw3 3:2we4 4:3er5 5:4rt6 6:5ty7 7:6yu8 8:7ui9 9:8io0 0:9op q:12wa w:3qeasd2 e:4wrsdf3 r:5etdfg4 t:6ryfgh5 y:7tughj6 u:8yihjk7 i:9uojkl8 o:0ipkl9 p:lo0 a:qwsz s:edxzaw d:rfcxse f:tgvcdr g:yhbvft h:ujnbgy j:ikmnhu k:olmji l:kop z:asx x:zsdc c:xdfv v:cfgb b:vghn n:bhjm m:njk"
_GLYPHS = "0:o 1:l,i 2:z 5:s 6:b 8:b 9:g,q b:d,lb,6 c:e d:b,cl,dl e:c g:q,9 h:lh i:1,l l:1,i m:n,nn,rn n:m,r o:0 q:g,9 s:5 u:v v:u w:vv z:2"
#: Candidates (domain, candidate, fuzzer) of the domains in ``d``, by joins of each letter's place with the tables.
_SQUATS = f"""n as (select domain, split_part(domain, '.', 1) as n, substr(domain, instr(domain, '.') + 1) as tld from d),
    spots as (select *, substr(n, 1, i - 1) as pre, substr(n, i, 1) as x, substr(n, i + 1) as post from (select *, unnest(range(1, len(n) + 1)) as i from n)),
    ks as (select split_part(e, ':', 1) as x, unnest(string_split(split_part(e, ':', 2), '')) as y from (select unnest(string_split('{_KEYS}', ' ')) as e)),
    gs as (select split_part(e, ':', 1) as x, unnest(string_split(split_part(e, ':', 2), ',')) as y from (select unnest(string_split('{_GLYPHS}', ' ')) as e)),
    bs as (select *, chr(xor(ascii(x), 1 << b)) as y from spots, (select unnest(range(7))::int as b)),
    made as (select domain, 1 as r, 'addition' as fuzzer, n || chr(97 + unnest(range(26))::int) as label, tld from n
    union all select domain, 0, 'tld-swap', n, unnest(string_split('{_SUFFIXES}', ' ')) from n
    union all select domain, 2, 'omission', pre || post, tld from spots union all select domain, 3, 'transposition', pre || substr(post, 1, 1) || x || substr(post, 2), tld from spots where post <> ''
    union all select domain, 4, 'repetition', pre || x || x || post, tld from spots union all select domain, 5, 'replacement', pre || y || post, tld from spots join ks using (x)
    union all select domain, 6, 'insertion', pre || y || x || post, tld from spots join ks using (x) union all select domain, 7, 'homoglyph', pre || y || post, tld from spots join gs using (x)
    union all select domain, 8, 'bitsquatting', pre || y || post, tld from bs where regexp_matches(y, '^[a-z0-9-]$') union all select domain, 9, 'hyphenation', pre || x || '-' || post, tld from spots where post <> ''
    union all select domain, 10, 'subdomain', pre || x || '.' || post, tld from spots where post <> ''
    union all select domain, 11, 'vowel-swap', pre || v || post, tld from spots, (select unnest(['a', 'e', 'i', 'o', 'u']) as v) where x in ('a', 'e', 'i', 'o', 'u')),
    squats as (select domain, label || '.' || tld as candidate, arg_min(fuzzer, r) as fuzzer from made where label || '.' || tld <> domain
    and list_bool_and(list_transform(string_split(label, '.'), lambda p: regexp_matches(p, '^[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?$'))) group by 1, 2)"""


@query("g1_typosquats", f"with {_DOMAINS}, {_SQUATS} select * from squats")
def squats(spark, sf):
    return g.typosquats(domains(spark, sf))


@query("g2_tld_candidates", f"with {_DOMAINS} select domain, split_part(domain, '.', 1) || '.' || t as candidate from d, (select unnest(string_split('{_SUFFIXES}', ' ')) as t) where split_part(domain, '.', 1) || '.' || t <> domain")
def tlds(spark, sf):
    return g.other_tlds(domains(spark, sf))


@query("g3_bucket_names", """with n as (select distinct lower(replace(p_brand, '#', '')) as name from part), c as (select name, i, case i when 0 then name when 1 then name || '-backup' when 2 then name || '-data' when 3 then name || '-dev' when 4 then name || '.static' when 5 then name || '_logs' when 6 then 'dev-' || name when 7 then 'prod-' || name else 'www.' || name end as bucket from n, (select unnest(range(9)) as i))
    select name, bucket, row_number() over (partition by name order by i)::int as place from c where regexp_matches(bucket, '^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$')""")
def buckets(spark, sf):
    return g.buckets(b.load(spark, sf, "part").selectExpr("lower(replace(p_brand, '#', '')) as name").distinct())


@query("g4_subdomain_candidates", f"with {_DOMAINS} select domain, w || '.' || domain as host from d, (select unnest(['www', 'mail', 'vpn', 'dev', 'api', 'admin']) as w)")
def hosts(spark, sf):
    return g.subdomains(domains(spark, sf))


@query("g5_service_names", f"with {_DOMAINS} select domain, s || '.' || domain as name from d, (select unnest(['_sip._tcp', '_ldap._tcp', '_xmpp-server._tcp', '_kerberos._udp']) as s)")
def services(spark, sf):
    return g.services(domains(spark, sf))


@query("g9_backup_urls", "select page_id, url || s as candidate from pages, (select unnest(['.bak', '.old', '~', '.zip', '.tar.gz']) as s)")
def backups(spark, sf):
    return g.backup_urls(b.load(spark, sf, "pages"))


@query("e18_lookalike_join", f"""with d as (select distinct array_to_string(list_slice(string_split(lower(regexp_extract(url, '//([^/:?#]+)', 1)), '.'), -2, -1), '.') as domain from pages
    union select 'brand' || lower(replace(substr(p_brand, 7), '#', '')) || '.' || ['com', 'net', 'co'][(p_partkey % 3)::int + 1] from part), {_SQUATS}
    select squats.domain, candidate, fuzzer from squats join d on candidate = d.domain""")
def lookalikes(spark, sf):
    """Domains of pages and brands that are look-alikes of another one."""
    brands = b.load(spark, sf, "part").selectExpr("concat('brand', lower(replace(substr(p_brand, 7), '#', '')), '.', element_at(array('com', 'net', 'co'), cast(p_partkey % 3 as int) + 1)) as domain")
    seen = b.page_hosts(spark, sf).select(F.substring_index("host", ".", -2).alias("domain")).union(brands).distinct()
    return g.typosquats(seen).join(seen.withColumnRenamed("domain", "candidate"), "candidate", "left_semi").select("domain", "candidate", "fuzzer")


@query("e20_username_sites", """select name, site, replace(t, '{}', name) as url from (select c_name as name from customer), (select unnest(['git', 'forum']) as site, unnest(['https://git.example/{}', 'https://forum.example/u/{}']) as t)""")
def users(spark, sf):
    names = b.load(spark, sf, "customer").selectExpr("c_name as name")
    return g.usernames(names, {"git": "https://git.example/{}", "forum": "https://forum.example/u/{}"})
