"""Compare queries with their DuckDB oracles: columns, row counts and values."""

from __future__ import annotations

from pathlib import Path

import duckdb

import __spark_entry__ as contract


def duckdb_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = con.sql(sql)
    return list(result.columns), result.fetchall()


def difference(spark, name: str, sf_dir: str) -> str | None:
    """None if the query agrees with its oracle, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    columns, expected = duckdb_rows(contract.oracle_sql()[name], sf_dir)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    expected = sorted((tuple(row) for row in expected), key=repr)
    if len(got) != len(expected):
        return f"{len(got)} rows instead of {len(expected)}"
    for g, e in zip(got, expected):
        if g != e:
            return f"{g!r:.600} instead of {e!r:.600}"
    return None
