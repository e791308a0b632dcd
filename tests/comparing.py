"""A query's rows against those of its DuckDB counterpart, as counts, names and values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(sf_dir, f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    """A value in a form that both engines share; rows are compared as sorted texts of these."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**5 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both agree, else what differs first."""
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours = rows_of(df.columns, [[r[c] for c in df.columns] for r in df.collect()])
    other = rows_of(names, theirs.fetchall())
    if len(ours) != len(other):
        return f"{len(ours)} rows and {len(other)}"
    for a, b in zip(ours, other):
        if a != b:
            return f"{str(a)[:300]} and {str(b)[:300]}"
    return None
