"""Run registered queries against their checking SQL: ``python -m suite.check [folder] [name-prefix ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

from gatehouse.session import build_session
from suite import load
from suite.registry import BASE_TABLES, REGISTRY


def canonical(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(name, spark, folder, connection):
    registered = REGISTRY[name]
    started = time.time()
    frame = registered.run(spark, folder)
    found = frame.collect()
    seconds = time.time() - started
    if registered.sql is None:
        return f"rows-only {len(found)}", seconds, True
    relation = connection.execute(registered.sql)
    columns = [d[0] for d in relation.description]
    expected = relation.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS {sorted(frame.columns)} != {sorted(columns)}", seconds, False
    ours, theirs = rows_of(frame.columns, found), rows_of(columns, expected)
    if ours == theirs:
        return f"ok {len(found)}", seconds, True
    extra, missing = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"DIFFERS {len(found)} vs {len(expected)}\n   only spark: {extra}\n   only duckdb: {missing}", seconds, False


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    load()
    spark = build_session(
        "check", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in REGISTRY:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            text, seconds, good = compare(name, spark, folder, connection)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            text, seconds, good = f"FAILED {type(error).__name__}: {str(error)[:600]}", 0.0, False
        bad += not good
        print(f"{name:40s} {seconds:6.2f}s {text}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
