"""Compares a Spark result with DuckDB's for the same tables, order of rows aside."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def compare(df, sql, folder):
    """Differences as a text, empty if there are none."""
    got_cols = sorted(df.columns)
    rel = duck(folder).sql(sql)
    want_cols = sorted(rel.columns)
    if got_cols != want_cols:
        return f"columns {got_cols} and {want_cols}"
    got = sorted(tuple(plain(r[c]) for c in got_cols) for r in df.collect())
    at = [rel.columns.index(c) for c in want_cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return ""
    g, w = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} and {len(want)} rows; only Spark {sorted(g)[:3]}; only DuckDB {sorted(w)[:3]}"
