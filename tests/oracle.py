"""Compare queries with their SQL: column names, row counts and values, whatever the order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19]
    if isinstance(x, (int, str)):
        return x
    return float(f"{float(x):.9g}")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    a, b = rows_of(df.columns, got), rows_of(names, cur.fetchall())
    if len(a) != len(b):
        return [f"{len(a)} rows against {len(b)}"]
    return [f"{x} against {y}" for x, y in zip(a, b) if x != y][:3]


SF = os.environ.get("CADENZA_SF", "/root/testdata/sf0.001")
