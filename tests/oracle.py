"""Runs a query's SQL in DuckDB over the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def compare(df, sql, sf_dir):
    cols = sorted(df.columns)
    r = connection(sf_dir).execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(x[names.index(k)]) for k in cols) for x in r.fetchall()), key=repr)
    ours = sorted((tuple(plain(x[k]) for k in cols) for x in df.collect()), key=repr)
    assert ours == theirs, (names, len(ours), len(theirs), [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3])
    return len(ours)
