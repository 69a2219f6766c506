"""Compares a query with its SQL over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def same(spark, data: str, query, sql: str) -> tuple[list, list]:
    known = duckdb.connect()
    known.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        known.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, data)
    columns = sorted(df.columns)
    done = known.execute(sql)
    at = [[x[0] for x in done.description].index(c) for c in columns]
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = sorted(map(plain, df.select(*columns).collect()), key=str)
    want = sorted((plain([row[k] for k in at]) for row in done.fetchall()), key=str)
    return got, want
