"""Rows of a query in Spark against its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "asDict"):
        return tuple(value(v) for v in x)
    return tuple(value(v) for v in x) if isinstance(x, (list, tuple)) else x


def differences(spark, query, sql, folder):
    """(columns of both, rows that only Spark has, rows that only the SQL has)."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want = Counter(tuple(value(r[names.index(c)]) for c in columns) for r in found.fetchall()) if sorted(names) == columns else Counter([tuple(names)])
    return got - want, want - got
