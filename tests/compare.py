"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), "" if v is None else str(v)) for v in row)


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, [tuple(_plain(r[c]) for c in columns) for r in df.select(*columns).collect()]


def duck_rows(con, query: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(query)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    return [names[i] for i in order], rows


def differences(df, con, query: str) -> list[str]:
    """Empty when columns, row count and every value agree."""
    left_names, left = spark_rows(df)
    right_names, right = duck_rows(con, query)
    if left_names != right_names:
        return [f"columns {left_names} != {right_names}"]
    if len(left) != len(right):
        return [f"{len(left)} rows != {len(right)}"]
    left, right = sorted(left, key=_key), sorted(right, key=_key)
    bad = [(a, b) for a, b in zip(left, right) if a != b or [type(x) for x in a] != [type(y) for y in b]]
    return [f"{len(bad)} of {len(left)} rows differ, e.g. {str(bad[0])[:600]}"] if bad else []
