"""Runs a query beside its SQL and compares the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def oracle_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def _plain(v):  # noqa: ANN001, ANN202
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def ordered(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, sql: str, folder: str) -> str:  # noqa: ANN001
    """'' if the rows agree, else what differs."""
    ours = ordered(df.columns, [tuple(r) for r in df.collect()])
    theirs = ordered(*oracle_rows(sql, folder))
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] == theirs[1]:
        return ""
    a, b = set(ours[1]), set(theirs[1])
    return f"rows {len(ours[1])} and {len(theirs[1])}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
