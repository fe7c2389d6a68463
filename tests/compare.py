"""Run one named query in Spark and its SQL in DuckDB, and compare the two as multisets."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(df, con, sql) -> str | None:
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want, wc = rows_of(rel.columns, rel.fetchall())
    if gc != wc:
        return f"columns {gc} != {wc}"
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    bad = [c for c, t in kinds.items() if "HUGEINT" in t or "DECIMAL" in t]
    if bad:
        return f"SQL types to cast: {[(c, kinds[c]) for c in bad]}"
    spark_kinds = dict(df.dtypes)
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    off = [(c, spark_kinds[c], kinds[c]) for c in kinds if pairs.get(spark_kinds[c], kinds[c]) != kinds[c]]
    if off:
        return f"types differ: {off}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(diff)} rows differ, e.g. {diff[:2]}"
    if not got:
        return "no rows"
    return None


def sf_dir(default: str = "0.001") -> str:
    return os.environ.get("SIFTMAP_SF_DIR", f"/root/testdata/sf{default}")
