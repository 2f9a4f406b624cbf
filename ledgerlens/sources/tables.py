"""Managed tables: full-refresh load as one, with an audit, post-load check, SQL views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.quality import schema_differences
from ledgerlens.schema import SCHEMAS, columns
from ledgerlens.session import staging_path
from ledgerlens.sources.snapshots import Digest, Load, begin, digest, digest_columns, manifest, table_path

_AUDIT = "table_name string, row_count bigint"

# Monthly facts by their month, so that a query over some months reads only those.
BY_MONTH = {"invoices": "invoice_date", "usage_monthly": "usage_month", "cloud_costs": "cost_month"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> Digest:
    """Replace the table at ``path`` and return the digest of its rows, taken while they are
    written.

    For a partitioned table rows are first rebalanced by that column: without it every
    task would write a file per month, and with a plain repartition one task a whole
    month. Adaptive execution splits the large months and merges the small ones.
    """
    seen = Observation()
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
    writer = df.observe(seen, *digest_columns(df)).write.mode("overwrite").format(fmt)
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return Digest(**seen.get)


def write_to(
    load: Load, dfs: Mapping[str, DataFrame], fmt: str = "parquet", partition_by: Mapping[str, str] | None = None, parallel: int = 4
) -> list[tuple[str, int]]:
    """Write tables into a load that is not published yet; rows by table.

    The tables do not depend on each other; a few are written at a time so that small ones
    do not leave executors idle.
    """
    partition_by = partition_by or {}

    def write(table: str) -> tuple[str, int]:
        found = write_table(dfs[table], load.path(table), fmt, partition_by.get(table))
        load.wrote(table, found)
        return table, found.rows

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(write, dfs))


def audit_of(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, _AUDIT)


def write_tables(
    dfs: Mapping[str, DataFrame],
    root: str,
    fmt: str = "parquet",
    partition_by: Mapping[str, str] | None = None,
    parallel: int = 4,
) -> DataFrame:
    """Replace all tables at once and return the audit, one (table_name, row_count) row each.
    If one cannot be written, none is replaced."""
    spark = next(iter(dfs.values())).sparkSession
    load = begin(spark, root)
    rows = write_to(load, dfs, fmt, partition_by, parallel)
    load.publish()
    return audit_of(spark, rows)


def _as_declared(stored: DataFrame, table: str) -> DataFrame:
    """The column a table is partitioned by comes back last, and typed by guess from the
    folder names; a complete table gets its declared shape again."""
    if sorted(stored.columns) != sorted(columns(table)):
        return stored
    moved = stored.columns != columns(table)
    return stored.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[table]]) if moved else stored


def read_table(spark: SparkSession, root: str, table: str, fmt: str = "parquet", number: int | None = None) -> DataFrame:
    """A stored table, of the newest load or of load ``number``."""
    return _as_declared(spark.read.format(fmt).load(table_path(spark, root, table, number)), table)


def read_tables(spark: SparkSession, root: str, tables=tuple(SCHEMAS), fmt: str = "parquet", number: int | None = None) -> dict[str, DataFrame]:
    """Tables of one load: the manifest is read once."""
    entries = manifest(spark, root, number)
    paths = {t: f"{root.rstrip('/')}/{entries.get(t, {'path': t})['path']}" for t in tables}
    return {t: _as_declared(spark.read.format(fmt).load(path), t) for t, path in paths.items()}


def read_from(load: Load, tables, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Tables of a load that is not published yet."""
    return {t: _as_declared(load.spark.read.format(fmt).load(load.path(t)), t) for t in tables}


def staged_tables(dfs: Mapping[str, DataFrame], wanted: Mapping[str, list[str]], parallel: int = 4) -> dict[str, DataFrame]:
    """The wanted columns of each table written to the shared folder and read back, for what reads
    tables several times that are costly to work out."""
    spark = next(iter(dfs.values())).sparkSession

    def stage(table: str) -> DataFrame:
        df = dfs[table].select(*wanted[table])
        path = staging_path(spark, table)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    with ThreadPoolExecutor(parallel) as pool:
        return dict(zip(dfs, pool.map(stage, dfs), strict=True))


def check_load(audit: DataFrame, root: str, fmt: str = "parquet") -> DataFrame:
    """Each audited table read back: rows expected and found, schema as declared, content as it was
    written (by its digest), complete if all hold. The audit has one row per table.
    """
    spark = audit.sparkSession
    expected = {r.table_name: r.row_count for r in audit.collect()}
    stored, entries = read_tables(spark, root, tuple(expected), fmt), manifest(spark, root)
    rows = []
    for table, count in expected.items():
        found, same = digest(stored[table]), not schema_differences(stored[table], table)
        content = table in entries and asdict(found) == entries[table]["digest"]
        rows.append((table, count, found.rows, same, content, same and content and found.rows == count))
    return spark.createDataFrame(
        rows, "table_name string, expected_rows bigint, found_rows bigint, schema_ok boolean, content_ok boolean, complete boolean"
    )


#: The day that says in which month a fact counts.
FACT_DAYS = {
    "invoices": "invoice_date", "payments": "payment_date", "usage_monthly": "usage_month", "support_cases": "opened_date",
    "cloud_costs": "cost_month",
}
MONTH = "fact_month"


def store_by_customer(dfs: Mapping[str, DataFrame], prefix: str, root: str, buckets: int = 200, parallel: int = 4) -> dict[str, str]:
    """Store tables for questions by customer: in ``buckets`` by customer_id, so that grouping by and
    joining on customers needs no shuffle, and facts by month within, so that a question over
    some months reads those. Names in the session's catalog, by table; files below ``root``.

    Rows are dealt by the buckets' own hash before they are written, so a bucket is one
    file a month. A customer with very many rows makes its bucket large: more buckets do not help,
    tables for questions on single rows are better stored by ``write_tables``.
    """

    def store(table: str) -> str:
        df, name = dfs[table], f"{prefix}_{table}"
        day = FACT_DAYS.get(table)
        df = df.withColumn(MONTH, F.trunc(day, "month")) if day else df
        writer = df.repartition(buckets, "customer_id").write.mode("overwrite").bucketBy(buckets, "customer_id").sortBy("customer_id")
        if day:
            writer = writer.partitionBy(MONTH)
        writer.option("path", table_folder(root, name)).saveAsTable(name)
        return name

    with ThreadPoolExecutor(parallel) as pool:
        return dict(zip(dfs, pool.map(store, dfs), strict=True))


def table_folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def in_months(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """The facts of some months, first to last, of a table stored by customer: other months'
    files are not opened."""
    return df.filter(F.col(MONTH).between(first, last))


def register_views(dfs: Mapping[str, DataFrame]) -> None:
    """The tables as temporary views, for ``spark.sql``."""
    for name, df in dfs.items():
        df.createOrReplaceTempView(name)
