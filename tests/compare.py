"""Run a query and its SQL on the same files and compare the rows as a bag."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda r: tuple((x is None, x or "") for x in r))


KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def compare(df, con, sql: str):
    """None when equal, else a description of the first difference."""
    relation = con.sql(sql)
    theirs, kinds = relation.columns, [str(t) for t in relation.types]
    if sorted(df.columns) != sorted(theirs):
        return f"columns {sorted(df.columns)} against {sorted(theirs)}"
    ours_kinds = dict(df.dtypes)
    for name, kind in zip(theirs, kinds):
        if KINDS.get(kind) != ours_kinds[name]:
            return f"type of {name}: {ours_kinds[name]} against {kind}"
    ours, expected = bag(df.columns, df.collect()), bag(theirs, relation.fetchall())
    if len(ours) != len(expected):
        return f"{len(ours)} rows against {len(expected)}"
    for a, b in zip(ours, expected):
        if a != b:
            return f"{a} against {b}"
    return None if ours else "no rows"
