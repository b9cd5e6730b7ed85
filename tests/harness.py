"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"create view {name} as select * from read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        (tuple(norm(r[i]) for i in order) for r in data), key=lambda t: tuple("" if x is None else x for x in t)
    )


def compare(spark_df, con, sql):
    """(ok, message, row count)"""
    c1, r1 = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    c2, r2 = rows(list(rel.columns), rel.fetchall())
    if c1 != c2:
        return False, f"columns {c1} vs {c2}", len(r1)
    if r1 == r2:
        return True, "", len(r1)
    s1, s2 = set(r1), set(r2)
    only1 = [r for r in r1 if r not in s2][:3]
    only2 = [r for r in r2 if r not in s1][:3]
    return False, f"{len(r1)} vs {len(r2)} rows\n  columns {c1}\n  spark only {only1}\n  duckdb only {only2}", len(r1)
