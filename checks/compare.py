"""Compare every query with its SQL on one directory of tables.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from ledgerlens.plans.queries import queries


def views(path: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(path).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    """Equal values of both engines as equal Python values; doubles by their exact bits."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def table(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(found, key=repr)


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    names, rows = table(df.columns, df.collect())
    result = connection.execute(sql)
    sql_names, sql_rows = table([d[0] for d in result.description], result.fetchall())
    if names != sql_names:
        return [f"columns {names} against {sql_names}"]
    if len(rows) != len(sql_rows):
        return [f"rows {len(rows)} against {len(sql_rows)}"]
    wrong = [(a, b) for a, b in zip(rows, sql_rows, strict=True) if a != b]
    types = {
        n
        for a, b in zip(rows, sql_rows, strict=True)
        for n, x, y in zip(names, a, b, strict=True)
        if x is not None and y is not None and type(x) is not type(y)
    }
    out = [f"{len(wrong)} of {len(rows)} rows, such as {wrong[0][0]} against {wrong[0][1]}"] if wrong else []
    return out + [f"type of {n}" for n in sorted(types)]


def session(cpus: int = 8, partitions: int = 8, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(path: str, chosen: list[str]) -> int:
    spark, connection, sql = session(), views(path), oracle_sql()
    failed = 0
    for name, run in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = run(spark, path)
            found = differences(df, connection, sql[name]) if name in sql else ["no SQL"]
        except Exception as error:  # noqa: BLE001 - report and go on
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.2f}s {'; '.join(found)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
