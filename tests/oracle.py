"""Runs registered queries beside their DuckDB SQL, compared like the driver does: names, row counts, values in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' where both agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    kinds = dict(zip(names, [str(d[1]) for d in result.description]))
    for name, kind in spark_df.dtypes:
        expected = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}.get(kind)
        if expected and kinds[name] not in (expected, "NUMBER", "STRING", "bool", "BOOL"):
            return f"type of {name}: {kind} and {kinds[name]}"
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    if ours != theirs:
        return next(f"{a}\n{b}" for a, b in zip(ours, theirs) if a != b)
    return "" if ours else "no rows on either side"
