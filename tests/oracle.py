"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def rows_of_sql(sql, root):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), Counter(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())


def same(df, sql, root):
    (columns, rows), (sql_columns, sql_rows) = rows_of(df), rows_of_sql(sql, root)
    assert columns == sql_columns
    assert rows == sql_rows, (list((rows - sql_rows))[:3], list((sql_rows - rows))[:3])
