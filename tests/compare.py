"""Rows of a query against its SQL over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(str([plain(r[c]) for c in columns]) for r in df.collect())


def sql_rows(con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
