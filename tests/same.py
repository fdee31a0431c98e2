"""Comparison of a Spark result with an oracle's rows, whatever their order."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def oracle_rows(con, sql):
    found = con.sql(sql)
    names = list(found.columns)
    columns = sorted(names)
    return columns, Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
