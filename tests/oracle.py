"""Side-by-side check of a query and its SQL: same columns, same multiset of rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in value) + "]"
    return repr(value) if isinstance(value, str) else str(value)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, directory: str) -> str:
    """'' when equal, else what differs."""
    df = query(spark, directory)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"{len(got[1])} rows against {len(want[1])}; only ours {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return ""
