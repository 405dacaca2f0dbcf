"""Spark queries against their SQL in DuckDB."""

import decimal
import os

import duckdb


def views(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in os.listdir(folder):
        c.execute(f"create view {t[:-8]} as select * from '{folder}/{t}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return str(v)


def same(spark, query, sql, folder):
    df = query(spark, folder)
    cols = sorted(df.columns)
    r = views(folder).execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
    ours = sorted(tuple(plain(x) for x in row) for row in df.select(*cols).collect())
    assert ours == theirs
