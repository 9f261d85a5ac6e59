"""Nested documents: registration records with contacts inside contacts, port scans as XML, findings as JSON lines.

Documents that can't be read give no rows. Values that are missing are null or empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many contacts deep a record is followed.
DEPTH = 4
_SCAN = """host array<struct<status: struct<_state: string>, address: array<struct<_addr: string, _addrtype: string>>,
    ports: struct<port: array<struct<_portid: string, _protocol: string, state: struct<_state: string>, service: struct<_name: string, _product: string, _version: string>>>>,
    os: struct<osmatch: array<struct<_name: string, _accuracy: string>>>>>"""


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(values: Column) -> Column:
    return F.get(values, 0)


def _filled(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def contacts(records: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, depth, handle, roles, kind, name, org, emails, phones, addresses, country): the contacts of records in JSON.

    A contact's card is a list of [name, parameters, type, value]; contacts may hold contacts, which are told with
    their ``depth`` (the outermost are 0), four levels in all. Organisations are those that say so, or whose name is
    that of their organisation.
    """
    inside = lambda v: F.coalesce(_at(v, "$.entities", "array<variant>"), F.array().cast("array<variant>"))
    levels = records.select(key, inside(F.try_parse_json(raw)).alias("_0"))  # a record is parsed once
    for depth in range(1, DEPTH):
        levels = levels.withColumn(f"_{depth}", F.flatten(F.transform(f"_{depth - 1}", inside)))
    at_depth = lambda depth: lambda e: F.struct(F.lit(depth).alias("depth"), e.alias("e"))
    told = [F.transform(f"_{depth}", at_depth(depth)) for depth in range(DEPTH)]
    rows = levels.select(key, F.explode(F.concat(*told)).alias("_r")).select(key, "_r.depth", "_r.e")
    card = F.filter(F.coalesce(_at(F.col("e"), "$.vcardArray[1]", "array<variant>"), F.array().cast("array<variant>")), lambda p: _at(p, "$[0]").isNotNull() & _at(p, "$[2]").isNotNull())
    carded = rows.withColumn("card", F.transform(card, lambda p: F.struct(F.lower(_at(p, "$[0]")).alias("name"), p.alias("p"))))
    of = lambda name: F.transform(F.filter("card", lambda c: c["name"] == name), lambda c: c["p"])
    text = lambda p: F.trim(_at(p, "$[3]"))

    def place(p: Column) -> Column:
        parts = F.array_join(_filled(F.coalesce(_at(p, "$[3]", "array<string>"), F.array(_at(p, "$[3]")))), ", ")
        return F.coalesce(F.nullif(F.trim(F.regexp_replace(_at(p, "$[1].label"), r"\s*\n\s*", ", ")), F.lit("")), parts)

    def land(p: Column) -> Column:
        return F.coalesce(F.upper(_at(p, "$[1].cc")), F.nullif(F.trim(_at(p, "$[3][6]")), F.lit("")))

    name, org = _first(F.transform(of("fn"), text)), _first(F.transform(of("org"), lambda p: F.trim(F.coalesce(_at(p, "$[3][0]"), _at(p, "$[3]")))))
    kind = F.lower(_first(F.transform(of("kind"), text)))
    places = of("adr")
    return carded.select(
        key, "depth", _at(F.col("e"), "$.handle").alias("handle"), F.coalesce(_at(F.col("e"), "$.roles", "array<string>"), F.array().cast("array<string>")).alias("roles"),
        F.coalesce(kind, F.when(name == org, "org")).alias("kind"), name.alias("name"), org.alias("org"), F.transform(of("email"), lambda p: F.lower(text(p))).alias("emails"),
        F.transform(of("tel"), lambda p: F.trim(F.regexp_replace(_at(p, "$[3]"), "^tel:", ""))).alias("phones"), F.filter(F.transform(places, place), lambda x: x != "").alias("addresses"),
        F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(places, land), lambda x: x.isNotNull())), -1).alias("country"),
    )


def port_scan(reports: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, host, kind, value, port, proto, service, confidence) of port scans in XML: hosts that are up, open ports, software, system.

    What stands before the XML is left out. A host is named by its first network address, else by its first address. The
    first guess of the system is told, as sure as the scan is of it.
    """
    text = F.expr(f"if(instr({raw}, '<?xml') > 1, substr({raw}, instr({raw}, '<?xml')), {raw})")
    hosts = reports.select(key, F.explode(F.from_xml(text, _SCAN, {"mode": "PERMISSIVE"})["host"]).alias("h"))
    named = lambda f: _first(F.transform(F.filter("h.address", f), lambda a: a["_addr"]))
    name = F.coalesce(named(lambda a: a["_addrtype"].isin("ipv4", "ipv6")), named(lambda a: a["_addr"].isNotNull()))
    up = hosts.where("h.status is null or h.status._state = 'up'").select(key, name.alias("host"), "h").where("host is not null")
    open_ = F.filter(F.coalesce("h.ports.port", F.array()), lambda p: p["state"].isNull() | (p["state"]["_state"] == "open"))
    none = F.lit(None)

    def found(kind: str, value: Column, port: Column = none, proto: Column = none, service: Column = none, sure: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), port.cast("int").alias("port"), proto.cast("string").alias("proto"), service.cast("string").alias("service"), F.coalesce(sure.cast("double"), F.lit(1.0)).alias("confidence"))

    ports = F.transform(open_, lambda p: found("open_port", F.concat_ws(":", "host", p["_portid"]), p["_portid"], F.coalesce(p["_protocol"], F.lit("tcp")), p["service"]["_name"]))
    software = F.transform(F.filter(open_, lambda p: p["service"]["_product"].isNotNull()), lambda p: found("software", F.concat_ws(" ", p["service"]["_product"], p["service"]["_version"])))
    system = F.filter(F.transform(F.slice(F.coalesce("h.os.osmatch", F.array()), 1, 1), lambda m: found("operating_system", m["_name"], sure=F.coalesce(m["_accuracy"].try_cast("double"), F.lit(100.0)) / 100)), lambda x: x["value"].isNotNull())
    every = F.concat(F.array(found("ip", F.col("host"))), ports, software, system)
    return up.select(key, "host", F.explode(every).alias("f")).select(key, "host", "f.*")


def findings(lines: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, host, kind, value, severity) of findings as JSON lines: an identifier of a weakness, or else the rule's name.

    Lines that are no JSON object, or without host or rule, give nothing.
    """
    x = F.from_json(raw, "host string, `template-id` string, info struct<name: string, severity: string, classification: struct<`cve-id`: array<string>>>, `matched-at` string")
    rows = lines.select(key, x.alias("x")).where("x.host is not null and x.`template-id` is not null")
    ids = F.transform(F.coalesce("x.info.classification.`cve-id`", F.array().cast("array<string>")), F.upper)
    each = F.when(F.size(ids) > 0, F.transform(ids, lambda i: F.struct(F.lit("vulnerability").alias("kind"), i.alias("value")))).otherwise(F.array(F.struct(F.lit("finding").alias("kind"), F.coalesce("x.info.name", "x.`template-id`").alias("value"))))
    return rows.select(key, "x.host", F.lower("x.info.severity").alias("severity"), F.explode(each).alias("f")).select(key, "host", "f.kind", "f.value", "severity").distinct()
