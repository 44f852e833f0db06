"""Runs a catalogue query on Spark and its SQL on DuckDB and compares all rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return repr(v) if isinstance(v, int) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Empty string when equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return ""
    only_a, only_b = list((a - b).items()), list((b - a).items())
    text = f"spark {len(got)} rows, sql {len(want)}; {len(only_a)} only spark, {len(only_b)} only sql"
    if only_a and only_b:
        x, y = sorted(only_a, key=str)[0][0], sorted(only_b, key=str)[0][0]
        cols = sorted(names)
        text += "; first: " + str([(c, p, r) for c, p, r in zip(cols, x, y) if p != r][:6]) + f" in {x[:4]}"
    return text
