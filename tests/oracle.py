"""Compare a query with its SQL in DuckDB, as the driver does: rows, columns, values without regard to order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql: str, sf_dir: str) -> None:
    rel = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (sorted(df.columns), sorted(rel.columns))
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not bad, (len(bad), bad[:3])
