"""Compares a query with its SQL in DuckDB: same columns, same multiset of rows."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def clean(v):
        if pd.isna(v):
            return None
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.9g}"
        return str(v)

    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=repr)


def differences(spark_df, con, sql: str) -> list:
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return [sorted(ours.columns), sorted(theirs.columns)]
    a, b = rows(ours), rows(theirs)
    if a == b:
        return []
    return [len(a), len(b), [x for x, y in zip(a, b) if x != y][:3], [y for x, y in zip(a, b) if x != y][:3]]
