"""A query's rows against its SQL's, whatever their order."""

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' * os.path.isdir(path)}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    return x


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(_plain(x) for x in r) for r in df.select(*names).collect()]


def difference(df, con, sql: str) -> str:
    """Empty if both are the same."""
    a_names, a = rows_of_spark(df)
    b_names, b = rows_of_sql(con, sql)
    if a_names != b_names:
        return f"columns {a_names} against {b_names}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} rows against {len(b)}; only in one: {only}"[:1500]
    return ""
