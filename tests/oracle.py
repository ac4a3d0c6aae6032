"""Compare a query with its SQL twin: columns, rows and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, in words; empty when both sides agree."""
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(expected_columns):
        return [f"columns {sorted(df.columns)} against {sorted(expected_columns)}"]
    order = [expected_columns.index(name) for name in df.columns]
    expected = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    found = Counter(tuple(_plain(v) for v in row) for row in df.collect())
    expected_types = {d[0]: str(d[1]) for d in cursor.description}
    problems = [
        f"{name} is {kind}, in SQL {expected_types[name]}"
        for name, kind in df.dtypes
        if TYPES.get(kind) != expected_types[name]
    ]
    if sum(found.values()) != sum(expected.values()):
        problems.append(f"{sum(found.values())} rows against {sum(expected.values())}")
    for row, side in [
        *((r, "only in Spark") for r in list((found - expected))[:2]),
        *((r, "only in SQL") for r in list((expected - found))[:2]),
    ]:
        problems.append(f"{side}: {row}")
    return problems
