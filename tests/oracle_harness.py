"""Runs a registered query in Spark and its oracle SQL in DuckDB on the same
parquet tables and compares row count, column names and an
order-insensitive value hash (floats rounded to 4 digits)."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 4) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4) + 0.0
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, bool):
        return int(v)
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest(), keyed


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    rel = con.execute(sql)
    o_cols = [d[0] for d in rel.description]
    o_rows = rel.fetchall()
    sh, sk = _digest(s_cols, s_rows)
    oh, ok = _digest(o_cols, o_rows)
    res = {"query": name, "rows_spark": len(s_rows), "rows_oracle": len(o_rows),
           "cols_match": sorted(s_cols) == sorted(o_cols), "hash_match": sh == oh}
    if not res["cols_match"]:
        res["cols"] = (sorted(s_cols), sorted(o_cols))
    if not res["hash_match"] and res["cols_match"]:
        ss, os_ = set(sk), set(ok)
        res["only_spark"] = sorted(ss - os_)[:3]
        res["only_oracle"] = sorted(os_ - ss)[:3]
    return res
