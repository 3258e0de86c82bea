"""Compare a query with its SQL text on the same tables."""

from __future__ import annotations

import datetime
import math

import duckdb

from epilode.catalog.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str, datetime.date, datetime.datetime)):
        return value
    if type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else the first difference."""
    got_cols, got = _rows(df.columns, df.collect())
    rel = con.execute(sql)
    want_cols, want = _rows([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}: {next((g for g in got if g not in set(want)), None)} / " \
               f"{next((w for w in want if w not in set(got)), None)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        g, w = wrong[0]
        kinds = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(got_cols, g, w) if type(a) is not type(b)]
        return f"{len(wrong)} of {len(got)} rows differ {got_cols} {str(g)[:300]} != {str(w)[:300]} {kinds}"
    return None
