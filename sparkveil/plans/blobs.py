"""Queries of what texts and files carry inside; their signs are written into the given rows by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blobs as x
from ..sources import bindings as b
from .registry import query


@query("d10_data_uris", """with t as (select doc_id, 'secret ' || doc_id || repeat('!', (doc_id % 4)::int) as body from documents where doc_id % 3 > 0)
    select doc_id, case when doc_id % 3 = 1 then 'image/svg+xml' else 'text/plain' end as mime, octet_length(encode(body)) as bytes, sha256(body) as sha256 from t""")
def uris(spark, sf):
    body = "base64(encode(concat('secret ', doc_id, repeat('!', cast(doc_id % 4 as int))), 'UTF-8'))"
    said = f"case doc_id % 3 when 0 then 'data:text/html,no base64 and data:;base64,A' when 1 then concat('DATA:image/svg+xml;charset=utf-8;base64,', {body}) else concat('(data:;base64,', rtrim('=', {body}), ')') end"
    return x.data_uris(b.load(spark, sf, "documents").selectExpr("doc_id", f"concat(text, ' ', {said}) as text"), "doc_id")


@query("d11_wide_strings", "select doc_id, unnest(case when doc_id % 2 = 0 then ['Wide text ' || doc_id, 'again'] else ['Wide text ' || doc_id] end) as string from documents where doc_id % 5 > 0")
def wide(spark, sf):
    raw = "if(doc_id % 5 = 0, encode(text, 'UTF-8'), concat(encode(text, 'UTF-8'), x'01', encode(concat('Wide text ', doc_id), 'UTF-16LE'), x'FFFE', encode('abc', 'UTF-16LE'), x'0101', if(doc_id % 2 = 0, encode('again', 'UTF-16LE'), x'')))"
    return x.wide_strings(b.load(spark, sf, "documents").selectExpr("doc_id", f"{raw} as content"), "doc_id", "content")


@query("c22_known_values", "select page_id, url || '?a=*** ***-b abc ' || case when page_id % 2 = 0 then '***' else 'none' end as text from pages")
def known(spark, sf):
    t = b.load(spark, sf, "pages").selectExpr("page_id", "concat(url, '?a=hunter22 hunter-b abc ', if(page_id % 2 = 0, 'hunter2222', 'none')) as text")
    return t.select("page_id", x.without_known(F.col("text"), ["hunter", "hunter22", "abc", "hunter2222", "hunter"]).alias("text"))


@query("j10_account_country", """with t as (select c_custkey as target, ['GB82 WEST 1234 5698 7654 32', 'de89370400440532013000', 'FR1420041010050500013M02606', 'GB83WEST12345698765432', 'XX', null][(c_custkey % 6)::int + 1] as iban from customer)
    select target, iban, ['GB', 'DE', 'FR', null, null, null][(target % 6)::int + 1] as country from t""")
def countries(spark, sf):
    t = b.load(spark, sf, "customer").selectExpr("c_custkey as target", "element_at(array('GB82 WEST 1234 5698 7654 32', 'de89370400440532013000', 'FR1420041010050500013M02606', 'GB83WEST12345698765432', 'XX', null), cast(c_custkey % 6 as int) + 1) as iban")
    return t.withColumn("country", x.account_country(F.col("iban")))


_PAGE = "concat(if(page_id % 2 = 0, '<BASE HREF=\"https://base.example/dir/page?q\">', ''), '<a class=x href=/root/', page_id, '>', '<area href=''../up/./here#top''><iframe src=\"//cdn.example/f\"></iframe><meta http-equiv=\"refresh\" content=\"5; URL=next?', page_id, '\"><a href=\"mailto:x@y.z\"><a href=\"#only\"><frame src=https://abs.example/a>')"


@query("d13_all_links", """with p as (select page_id, case when page_id % 2 = 0 then 'https://base.example' else regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) end as root, case when page_id % 2 = 0 then '/dir/page?q' else '/deep/er/x.html' end as path from pages)
    select page_id, 'link' as via, root || '/root/' || page_id as target from p union all select page_id, 'link', root || case when page_id % 2 = 0 then '/up/here' else '/deep/up/here' end from p
    union all select page_id, 'frame', split_part(root, ':', 1) || '://cdn.example/f' from p union all select page_id, 'frame', 'https://abs.example/a' from p union all select page_id, 'link', root || path from p
    union all select page_id, 'refresh', root || case when page_id % 2 = 0 then '/dir/' else '/deep/er/' end || 'next?' || page_id from p""")
def links(spark, sf):
    pages = b.load(spark, sf, "pages").selectExpr("page_id", "concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/deep/er/x.html') as url", f"{_PAGE} as html")
    return x.all_links(pages)
