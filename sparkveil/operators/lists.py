"""Published indicator lists and crawl indexes: lines of one layout each become (kind, value, note) or page rows.

``lines`` has line (text) and whatever else goes through. Lines of another form give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parts import dealt_by

#: File endings of pages worth a closer look.
INTERESTING = ("sql", "bak", "zip", "tar.gz", "env", "log", "conf", "pem", "key")
_IP4 = r"^(?:\d{1,3}\.){3}\d{1,3}$"
_HASH = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"


def kind_of(value: Column) -> Column:
    """Kind of an indicator by its form alone."""
    return F.when(value.rlike(_IP4), "ip").when(value.rlike("^https?://"), "url").when(value.rlike(_HASH), "hash").when(value.rlike(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)+$"), "host")


def csv_indicators(lines: DataFrame, column: int, note: int | None = None, columns: int = 8) -> DataFrame:
    """Indicators of the ``column``-th field of quoted CSV lines; comments and lines whose field is no indicator (a header) go."""
    fields = F.from_csv("line", ", ".join(f"f{i} string" for i in range(columns)), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = lines.where(~F.ltrim("line").startswith("#")).withColumn("_f", fields)
    value = F.lower(F.col(f"_f.f{column}"))
    said = F.col(f"_f.f{note}") if note is not None else F.lit(None).cast("string")
    return rows.withColumns({"kind": kind_of(value), "value": value, "note": said}).where("kind is not null").drop("_f", "line")


def botnet_json(lines: DataFrame) -> DataFrame:
    """Controllers of botnets as JSON objects: the address, noted with malware and status."""
    x = F.from_json("line", "ip_address string, malware string, status string")
    rows = lines.withColumn("_x", x).where("_x.ip_address is not null")
    return rows.withColumns({"kind": F.lit("ip"), "value": F.col("_x.ip_address"), "note": F.format_string("%s (%s)", "_x.malware", "_x.status")}).drop("_x", "line")


def phish_csv(lines: DataFrame) -> DataFrame:
    """Phishing lines date,score,url,ip: one row for the URL and one for the address, noted with score and date."""
    x = F.from_csv("line", "d string, s string, u string, i string")
    rows = lines.where(~F.col("line").startswith("#")).withColumn("_x", x).where("_x.u like 'http%'")
    both = F.explode(F.array(F.struct(F.lit("url").alias("kind"), F.col("_x.u").alias("value")), F.struct(F.lit("ip").alias("kind"), F.col("_x.i").alias("value"))))
    out = rows.withColumn("_v", both).where("_v.value is not null and _v.value <> ''")
    return out.withColumns({"kind": F.col("_v.kind"), "value": F.col("_v.value"), "note": F.format_string("score %s (%s)", "_x.s", "_x.d")}).drop("_x", "_v", "line")


def panels(lines: DataFrame) -> DataFrame:
    """Panel addresses [scheme://]host[:port]/path: the host counts, the path is its note; # and < lines go."""
    form = r"^(?:[a-z]+://)?([^/:\s]+)(?::\d+)?(/\S*)?$"
    rows = lines.where(~F.col("line").rlike("^[#<]") & F.col("line").rlike(form))
    value = F.lower(F.regexp_extract("line", form, 1))
    return rows.withColumns({"kind": kind_of(value), "value": value, "note": F.nullif(F.regexp_extract("line", form, 2), F.lit(""))}).where("kind is not null").drop("line")


def noted(lines: DataFrame, until_comma: bool = False) -> DataFrame:
    """``indicator # note`` lines; with ``until_comma`` the note ends at its first comma."""
    rows = lines.where(~F.col("line").startswith("#") & F.col("line").contains("#"))
    value, note = F.lower(F.trim(F.substring_index("line", "#", 1))), F.trim(F.regexp_extract("line", "#(.*)$", 1))
    return rows.withColumns({"kind": kind_of(value), "value": value, "note": F.substring_index(note, ",", 1) if until_comma else note}).where("kind is not null").drop("line")


def with_port(lines: DataFrame) -> DataFrame:
    """``ip:port`` lines: the address, noted with its port."""
    form = r"^((?:\d{1,3}\.){3}\d{1,3}):(\d+)$"
    rows = lines.where(F.col("line").rlike(form))
    return rows.withColumns({"kind": F.lit("ip"), "value": F.regexp_extract("line", form, 1), "note": F.concat(F.lit("port "), F.regexp_extract("line", form, 2))}).drop("line")


def crawl_index(lines: DataFrame) -> DataFrame:
    """Pages of a crawl index as JSON lines: url, status, mime, host and whether its file ending is of interest."""
    rows = lines.withColumn("_x", F.from_json("line", "url string, status string, mime string")).where("_x.url rlike '^https?://'")
    host = F.lower(F.regexp_extract("_x.url", "^https?://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("_x.url", "^https?://[^/?#]+([^?#]*)", 1))
    ending = path.rlike(r"\.(?:" + "|".join(e.replace(".", r"\.") for e in INTERESTING) + ")$")
    return rows.select(*[c for c in lines.columns if c != "line"], F.col("_x.url").alias("url"), F.col("_x.status").alias("status"), F.col("_x.mime").alias("mime"), host.alias("host"), ending.alias("interesting"))


def says_missing(body: Column, messages: Column) -> Column:
    """Whether a page says that there is no such account: it holds one of ``messages``."""
    return F.exists(F.coalesce(messages, F.array().cast("array<string>")), lambda m: (m != "") & F.contains(body, m))


def sent_on(final_url: Column, error_url: Column) -> Column:
    """Whether an answer came from ``error_url``, but for slashes at the end. Trimming is dear, so beginnings are compared first."""
    bare = lambda url: F.when(F.endswith(url, F.lit("/")), F.rtrim(url, F.lit("/"))).otherwise(url)
    return F.coalesce((error_url != "") & F.startswith(final_url, bare(error_url)) & (bare(final_url) == bare(error_url)), F.lit(False))


def account_exists(answers: DataFrame) -> DataFrame:
    """``answers`` with account: whether an answer (status, final_url, body) says that an account exists.

    Sites differ in ``style``: ``status_code`` (any 2xx), ``message`` (2xx and none of ``messages`` in the body) or
    ``response_url`` (2xx, and not sent on to ``error_url``). No other status says so, whatever the style. Where many
    answers share a body or final_url, these may be judged once before, by ``says_missing`` and ``sent_on``: columns
    ``missing`` and ``sent_on`` stand for the texts.
    """
    missing = F.col("missing") if "missing" in answers.columns else says_missing(F.col("body"), F.col("messages"))
    back = F.col("sent_on") if "sent_on" in answers.columns else sent_on(F.col("final_url"), F.col("error_url"))
    told = F.when(F.col("style") == "message", ~missing).when(F.col("style") == "response_url", ~back).otherwise(True)
    return answers.withColumn("account", F.coalesce(F.col("status").between(200, 299) & told, F.lit(False)))


#: How sure a match with an entry of a feed is that says nothing itself, by kind.
SURE = {"ip": 0.95, "url": 0.95, "host": 0.95, "hash": 0.98, "asn": 0.9, "network": 0.8}


def feed_matches(targets: DataFrame, feed: DataFrame) -> DataFrame:
    """(target, kind, value, list, category, note, confidence): targets (target, kind, value) that a feed lists.

    ``feed`` has the columns of ``sources.list_source``. AS numbers match with or without letters before them; addresses
    also match the feed's networks. Each entry of a list counts once; a feed's own confidence goes before the kind's.
    """
    from . import networks

    listed = dealt_by(feed.where("reject is null"), "kind", "value").groupBy("list", "kind", "value").agg(F.min("category").alias("category"), F.min("note").alias("note"), F.max("confidence").alias("own"))
    number = F.regexp_replace("value", "(?i)^asn?", "")
    asked = targets.select("target", "kind", F.when(F.col("kind") == "asn", number).when(F.col("kind") == "hash", F.lower("value")).otherwise(F.col("value")).alias("value"))
    exact = dealt_by(asked, "kind", "value").join(listed.where("kind <> 'network'"), ["kind", "value"]).withColumn("sure", F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv])[F.col("kind")])
    nets = networks.parsed(listed.where("kind = 'network'").select("list", "category", "note", "own", F.col("value").alias("cidr")))
    inside = networks.in_networks(networks.located(asked.where("kind = 'ip'"), "value"), nets)
    near = inside.select("kind", "cidr", "target", "list", "category", "note", "own").withColumn("kind", F.lit("network")).withColumnRenamed("cidr", "value").withColumn("sure", F.lit(SURE["network"]))
    both = exact.select("target", "kind", "value", "list", "category", "note", "own", "sure").unionByName(near.select("target", "kind", "value", "list", "category", "note", "own", "sure"))
    return both.select("target", "kind", "value", "list", "category", "note", F.coalesce("own", "sure").alias("confidence"))
