"""Runs a query and its SQL over the same tables and compares rows by name of column."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, sf_dir: str, run, sql: str) -> list[str]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    df = run(spark, sf_dir)
    ours = [r.asDict() for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    key = lambda rows: sorted((tuple(plain(r[c]) for c in sorted(names)) for r in rows), key=repr)
    a, b = key(ours), key(theirs)
    return [] if a == b else [f"{len(a)} and {len(b)} rows", *(f"{x} / {y}" for x, y in zip(a, b, strict=False) if x != y)][:4]
