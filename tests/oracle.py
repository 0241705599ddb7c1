"""Compares a Spark result with DuckDB's rows for the same tables."""

import math

import duckdb

from waystone.plans.fixtures import TABLES


def connection(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def same(df, sql, c):
    found = c.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    mine, other = rows(df.columns, [tuple(r) for r in df.collect()]), rows(found.columns, found.fetchall())
    assert len(mine) == len(other)
    near = lambda a, b: a == b or _close(a, b)
    wrong = [(a, b) for a, b in zip(mine, other, strict=True) if not all(map(near, a, b))]
    assert not wrong, wrong[:3]


def _close(a, b):
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-7, abs_tol=1e-9)
    except ValueError:
        return False
