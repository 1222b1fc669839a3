"""A query's rows against its DuckDB equivalent on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def differences(df, sql: str, sf_dir: str, folder: str) -> list:
    """Rows on one side only, as (side, row); the column names if they differ."""
    df.write.mode("overwrite").parquet(folder)
    con = connect(sf_dir)
    con.execute(f"CREATE TABLE a AS SELECT * FROM '{folder}/*.parquet'")
    con.execute(f"CREATE TABLE b AS {sql}")
    names = [sorted(r[0] for r in con.execute(f"DESCRIBE {t}").fetchall()) for t in "ab"]
    if names[0] != names[1]:
        return [("columns", *names)]
    cols = ", ".join(f'"{c}"' for c in names[0])
    out = []
    for x, y in ("ab", "ba"):
        out += [(x, r) for r in con.execute(f"SELECT {cols} FROM {x} EXCEPT ALL SELECT {cols} FROM {y} LIMIT 3").fetchall()]
    return out
