"""Side-by-side check of a Spark query against its DuckDB SQL twin:
row count, column names, coarse types and an order-insensitive comparison
of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "num"
    if isinstance(v, str):
        return "str"
    return type(v).__name__


def compare(spark_df, con, sql: str) -> dict:
    cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_cols": sorted(cols), "oracle_cols": sorted(d_cols)}
    out["cols_ok"] = sorted(cols) == sorted(d_cols)
    if not out["cols_ok"]:
        out["ok"] = False
        return out
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    d_order = [d_cols.index(cols[i]) for i in order]
    a = sorted((tuple(_norm(r[i]) for i in order) for r in s_rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in d_order) for r in d_rows), key=repr)
    out["values_ok"] = a == b
    kinds_a = {cols[i]: {_kind(r[i]) for r in s_rows} - {"null"} for i in order}
    kinds_b = {cols[i]: {_kind(r[d_cols.index(cols[i])]) for r in d_rows} - {"null"} for i in order}
    out["types_ok"] = all(kinds_a[c] == kinds_b[c] or not kinds_a[c] or not kinds_b[c] for c in kinds_a)
    out["ok"] = out["values_ok"] and out["types_ok"] and len(s_rows) == len(d_rows)
    if not out["values_ok"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = list(sa - sb)[:3]
        out["only_oracle"] = list(sb - sa)[:3]
    if not out["types_ok"]:
        out["kinds"] = {c: (sorted(kinds_a[c]), sorted(kinds_b[c])) for c in kinds_a
                        if kinds_a[c] != kinds_b[c]}
    return out
