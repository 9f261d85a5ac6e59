"""Queries of exports, reports, saved answers and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, pages, sinks
from ..sources import bindings as b
from . import records
from .registry import ORACLES, query, sql


@query("b4_satellite_export", f"""select norad_id, '{{"type":"Feature","id":"space:' || norad_id || '","geometry":null,"properties":{{"norad_id":' || norad_id || ',"name":"' || name || '","epoch_year":' || epoch_year || ',"epoch_day":1.5,"inclination":' || inclination || ',"mean_motion":15.5,"layer":"space"}}}}' as feature from ({ORACLES['a4_k8_satellites']})""")
def satellites(spark, sf):
    return sinks.satellite_features(records.satellites(spark, sf))


@query("b6_feed_report", sql("""with c as (select module, count(*) filter (kind = 'poll.ok') as ok, count(*) filter (kind = 'poll.error') as failed, sum(case when kind = 'sink.stats' then rows else 0 end)::bigint as stored from journal group by module),
    v as (select *, case when ok + failed = 0 then 'NOT DUE' when ok = 0 then 'FAIL' when round(100::double * ok / (ok + failed), 2) < 50 then 'WARN' else 'PASS' end as verdict from c)
    select '| module | ok | failed | stored | verdict |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg('| ' || module || ' | ' || ok || ' | ' || failed || ' | ' || stored || ' | ' || verdict || ' |', chr(10) order by module) as text from v""", "journal"))
def report(spark, sf):
    return sinks.markdown(aggregates.scorecard(b.journal(spark, sf)).select("module", "ok", "failed", "stored", "verdict"), "module")


_MISSING = "The page you asked for could not be found on this server. Please check the address, or go back to the start page and search from there."


@query("c25_junk_files", f"""with a as (select page_id, 'h' || page_id % 50 as host, '/f/' || page_id || '.bak' as path, case when page_id % 6 = 5 then 404 when page_id % 2 = 0 then 200 else 206 end as status,
        case page_id % 6 when 0 then '{_MISSING} /f/' || page_id || '.bak' when 1 then 'id;name' || chr(10) || page_id || ';' || substr(html, 1, 300) when 2 then '{_MISSING} ref ' || 1000000 + page_id when 3 then '' when 4 then replace('{_MISSING}', 'Please', 'Kindly') || ' ref 7654321' else 'x' end as body from pages)
    select host, path, status, len(body) as size from a where page_id % 6 = 1""")
def junk(spark, sf):
    p = b.load(spark, sf, "pages").selectExpr("page_id", "concat('h', page_id % 50) as host", "concat('/f/', page_id, '.bak') as path", "if(page_id % 6 = 5, 404, if(page_id % 2 = 0, 200, 206)) as status", f"""case page_id % 6 when 0 then concat('{_MISSING} /f/', page_id, '.bak')
        when 1 then concat('id;name\\n', page_id, ';', substr(html, 1, 300)) when 2 then concat('{_MISSING} ref ', 1000000 + page_id) when 3 then '' when 4 then concat(replace('{_MISSING}', 'Please', 'Kindly'), ' ref 7654321') else 'x' end as body""")
    controls = p.select("host").distinct().selectExpr("host", f"explode(array('{_MISSING} /never/1', '{_MISSING} ref 9876543')) as body", "'/never/1' as path")
    return pages.exposed_files(p, controls)


@query("d18_address_forms", """with p as (select page_id, 'example' || page_id % 9 || '.org' as domain from pages)
    select page_id, 'email' as kind, 'info' || page_id || '@' || domain as value, 0.6::double as confidence from p
    union all select page_id, 'email_pattern', case when page_id % 2 = 0 then '{first}.{last}@' else '{f}{last}@' end || domain, 0.6::double from p where page_id % 3 > 0""")
def forms(spark, sf):
    p = b.load(spark, sf, "pages").selectExpr("page_id", "concat('example', page_id % 9, '.org') as domain", "html")
    told = "if(page_id % 3 = 0, '<i>{page}@</i>', if(page_id % 2 = 0, '<b>{First}.{last}@</b>', '<b>{f}{last}@</b>'))"
    return pages.address_forms(p.selectExpr("page_id", "domain", f"concat(html, '<p>Info', page_id, '@', domain, ' other@example.net</p>', {told}, '<p>INFO', page_id, '@', domain, '</p>') as html"), "page_id")


@query("d19_document_metadata", """select doc_id, unnest(['Author', 'Producer', 'CreationDate']) as field, unnest(['person', 'software', 'timestamp']) as kind, unnest(['Ana (' || doc_id || ')', 'Writer ' || doc_id % 10, (1704067200 + doc_id % 86400)::varchar]) as value from documents where doc_id % 5 > 0""")
def metadata(spark, sf):
    info = """concat(if(doc_id % 5 = 0, '', '%PDF-1.4\\n'), text, '\\n<< /Author (Ana \\\\(', doc_id, '\\\\)) /Producer(Writer ', doc_id % 10, ') /Creator () /CreationDate (D:', date_format(timestamp_seconds(1704067200 + doc_id % 86400), 'yyyyMMddHHmmss'), 'Z) >>')"""
    return pages.document_metadata(b.load(spark, sf, "documents").selectExpr("doc_id", f"encode({info}, 'UTF-8') as content"), "doc_id")
