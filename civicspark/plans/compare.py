"""Order-insensitive comparison of a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, bool):
        return v
    return v


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_cell(r[i]) for i in order] for r in rows), key=repr)


def compare(df: DataFrame, con, sql: str | None) -> str:
    """``ok ...`` or a description of the first difference."""
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"ok rows-only {len(got)}"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} sql {sorted(names)}"
    if len(got) != len(want):
        return f"row counts differ: spark {len(got)} sql {len(want)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    for x, y in zip(a, b):
        if x != y:
            return f"values differ: {sorted(names)} spark {x} sql {y}"
        if [type(i) for i in x] != [type(i) for i in y]:
            return f"types differ: {sorted(names)} spark {x} sql {y}"
    return f"ok {len(got)}" + (" EMPTY" if not got else "")
