"""Compare a registered query with its SQL in DuckDB, columns by name, rows in any order."""

from __future__ import annotations

import os

import duckdb

SMALL = os.environ.get("QUERN_TESTDATA", "/root/testdata/sf0.001")


def connection(folder: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def text(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def assert_same(spark, con, query, sql: str, folder: str) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(text(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    names = [x[0] for x in con.execute(f"DESCRIBE {sql}").fetchall()]
    assert columns == sorted(names)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    assert got == sorted(tuple(text(v) for v in r) for r in want)
