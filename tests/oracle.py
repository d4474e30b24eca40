"""Rows of a query and of its SQL, comparable."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        return tuple(map(plain, x))
    if type(x).__name__ in ("Decimal",):
        return round(float(x), 6) + 0.0
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(str(plain(r[i])) for i in order) for r in values)


def both(spark, con, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    want = rows([d[0] for d in out.description], out.fetchall())
    return got, want
