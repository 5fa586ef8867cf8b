"""Run a query on Spark and its statement on DuckDB and compare the rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(name, item, spark, sf_dir, db) -> str | None:
    """None when equal, else a description."""
    frame = item.run(spark, sf_dir)
    doubles = {f.name for f in frame.schema.fields if f.dataType.typeName() in ("double", "float")}
    left_columns, left = rows_of(frame.columns, frame.collect())
    if item.sql is None:
        return None
    if doubles != set(item.digits):
        return f"{name}: double columns {sorted(doubles)} but digits for {sorted(item.digits)}"
    cursor = db.execute(item.oracle())
    right_columns, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"{name}: columns {left_columns} != {right_columns}"
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"{name}: rows {sum(left.values())} vs {sum(right.values())}; columns {left_columns}\n"
            f"  only spark {sum(only_left.values())}: {sorted(only_left, key=repr)[:3]}\n  only duckdb {sum(only_right.values())}: {sorted(only_right, key=repr)[:3]}"
        )
    return None if sum(left.values()) else f"{name}: no rows"
