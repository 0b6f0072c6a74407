"""Order-blind comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(frame, con, sql: str) -> list[str]:
    """What differs between the two results; empty when they agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    expected = bag(names, cursor.fetchall())
    found = bag(frame.columns, frame.collect())
    out = []
    if found != expected:
        out.append(f"rows {sum(found.values())} vs {sum(expected.values())}")
        out += [f"only spark: {r}" for r in list((found - expected))[:2]]
        out += [f"only sql:   {r}" for r in list((expected - found))[:2]]
    return out
