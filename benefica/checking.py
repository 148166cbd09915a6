"""Order-free comparison of a query with its SQL in the checking engine (used by tests and check.py)."""

from __future__ import annotations

import datetime
import decimal
import math

from benefica.tables import BASE


def oracle_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b and type(a) is type(b)


def compare(q, spark, con, folder: str) -> str:
    df = q(spark, folder)
    cols, rows = shape(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return f"ok rows only: {len(rows)} rows" if rows else "EMPTY"
    cur = con.execute(q.oracle())
    want_cols, want = shape([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"COLUMNS {cols} against {want_cols}"
    if len(rows) != len(want):
        return f"ROWS {len(rows)} against {len(want)}; first {rows[:1]} {want[:1]}"
    off = [(a, b) for a, b in zip(rows, want) if not all(same(x, y) for x, y in zip(a, b))]
    if off:
        return f"VALUES differ in {len(off)} of {len(rows)} rows, columns {cols}: {off[0]}"
    return f"ok {len(rows)} rows" if rows else "EMPTY both"
