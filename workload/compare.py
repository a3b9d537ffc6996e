"""Side-by-side check of a registered query against its DuckDB statement."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(x):
    if x is None:
        return "∅"
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.6g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(norm(i) for i in x) + "]"
    return str(x)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data), [columns[i] for i in order]


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want, want_cols = rows_of(cols, cur.fetchall())
    problems = []
    if got_cols != want_cols:
        problems.append(f"columns {got_cols} != {want_cols}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        g, w = set(got) - set(want), set(want) - set(got)
        problems.append(f"only spark: {sorted(g)[:3]} only oracle: {sorted(w)[:3]}")
    return len(got), problems
