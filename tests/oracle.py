"""Comparison of a Spark result with DuckDB's, by sorted columns and rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 4) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, bool) else (False, "b", int(x)) for x in r))


def difference(df, con, sql: str) -> str:
    """Empty if both results are the same, else what differs."""
    cursor = con.execute(sql)
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b and not all(x == y or isinstance(x, float | int) and isinstance(y, float | int) and abs(x - y) <= 2e-4 * max(1, abs(x)) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return ""
