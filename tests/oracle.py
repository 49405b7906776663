"""Run a query and its SQL, and give both as sorted rows of text."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return c


def text(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(text(r[i]) for i in order) for r in data)


def both(spark, c, query, sql, sf_dir):
    got = query(spark, sf_dir)
    want = c.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    return rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want.fetchall())
