"""Rows of a query and of its DuckDB SQL, as comparable sorted lists."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def both(spark, build, sql: str, sf_dir: str, con=None):
    df = build(spark, sf_dir)
    cur = (con or duck(sf_dir)).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    return normal([tuple(r) for r in df.collect()], df.columns), normal(cur.fetchall(), names)
