"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

from legnet.checks.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_norm(row[i]) for i in order) for row in rows), key=lambda t: repr(t)
    )


def compare(spark, con, query, sql, sf_dir):
    """(matches, message) of one query against its SQL."""
    df = query(spark, sf_dir)
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first {bad[0]} {sorted(got_cols)}"
    return True, f"{len(got)} rows"
