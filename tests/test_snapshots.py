"""Loads replace a set of tables as one."""

from __future__ import annotations

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.plans.summary import load_with_summary, with_summary
from ledgerlens.sources import snapshots, tables


@pytest.fixture(scope="module")
def complete(company):
    return with_summary(company)


def stored(spark, root):
    return {t: rows(df) for t, df in tables.read_tables(spark, root).items()}


def changed(dfs):
    return {t: df.limit(1) for t, df in dfs.items()}


def test_a_load_that_fails_after_five_tables_changes_nothing(spark, complete, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.write_tables(complete, root)
    before = stored(spark, root)
    written, real = [], tables.write_table

    def failing(df, path, *args):
        if len(written) == 5:
            raise OSError("the disk is full")
        written.append(path)
        return real(df, path, *args)

    monkeypatch.setattr(tables, "write_table", failing)
    with pytest.raises(OSError):
        tables.write_tables(changed(complete), root, parallel=1)
    assert len(written) == 5 and stored(spark, root) == before
    monkeypatch.undo()
    tables.write_tables(changed(complete), root)
    assert all(len(r) == 1 for r in stored(spark, root).values())


def test_a_load_that_fails_in_a_task_changes_nothing(spark, company, tmp_path):
    root = str(tmp_path)
    load_with_summary(company, root)
    before = stored(spark, root)
    broken = {**changed(company), "payments": company["payments"].withColumn("payment_id", F.raise_error(F.lit("lost")).cast("string"))}
    with pytest.raises(Exception, match="lost"):
        load_with_summary(broken, root)
    assert stored(spark, root) == before


def test_some_tables_replaced_others_stay(spark, complete, tmp_path):
    root = str(tmp_path)
    tables.write_tables(complete, root)
    tables.write_tables({"payments": complete["payments"].limit(0)}, root)
    assert tables.read_table(spark, root, "payments").count() == 0
    assert rows(tables.read_table(spark, root, "invoices")) == rows(complete["invoices"])
    assert rows(tables.read_table(spark, root, "payments", number=1)) == rows(complete["payments"]), "an earlier load can be read"


def test_of_two_loads_at_once_one_is_refused(spark, complete, tmp_path):
    root = str(tmp_path)
    first, second = snapshots.begin(spark, root), snapshots.begin(spark, root)
    one = {"payments": complete["payments"]}
    tables.write_to(first, one)
    tables.write_to(second, {"payments": complete["payments"].limit(0)})
    assert first.publish() == 1
    with pytest.raises(snapshots.ConflictingLoad):
        second.publish()
    assert rows(tables.read_table(spark, root, "payments")) == rows(complete["payments"])
    assert [f for f in os.listdir(tmp_path / snapshots.MANIFESTS) if f.endswith(".json")] == ["0000000001.json"]


def test_vacuum_keeps_what_the_newest_loads_name(spark, complete, tmp_path):
    root = str(tmp_path)
    for n in (1, 2, 3, 4):
        tables.write_tables({"payments": complete["payments"].limit(n % 3), "products": complete["products"]}, root)
    tables.write_to(snapshots.begin(spark, root), {"payments": complete["payments"]})
    assert len(snapshots.vacuum(spark, root, keep=2)) == 3
    assert tables.read_table(spark, root, "payments").count() == 1
    assert tables.read_table(spark, root, "payments", number=3).count() == 0
    assert snapshots.vacuum(spark, root, keep=2) == []


def test_without_a_load_a_table_is_the_folder_of_its_name(spark, complete, tmp_path):
    complete["payments"].write.parquet(str(tmp_path / "payments"))
    assert rows(tables.read_table(spark, str(tmp_path), "payments")) == rows(complete["payments"])


def test_digest_is_of_rows_not_of_their_order(spark, complete):
    df = complete["invoices"]
    whole = snapshots.digest(df)
    assert snapshots.digest(df.orderBy(F.rand(3)).repartition(3)) == whole and whole.rows == 4
    row = df.filter("invoice_id = 'I2'")
    others = [df.union(row), df.filter("invoice_id <> 'I2'"), df.withColumn("amount", F.round("amount")), df.union(row).union(row)]
    assert len({snapshots.digest(d) for d in [df, *others]}) == 5
    a = spark.createDataFrame([(None, "x"), ("", "y")], "a string, b string")
    b = spark.createDataFrame([("x", None), ("", "y")], "a string, b string")
    c = spark.createDataFrame([(None, "x"), (None, "y")], "a string, b string")
    assert snapshots.digest(a) != snapshots.digest(b) and snapshots.digest(a) != snapshots.digest(c)
    assert snapshots.digest(a, blank_is_null=True) == snapshots.digest(c, blank_is_null=True)
    assert snapshots.digest(a.limit(0)) == snapshots.Digest(0, 0, 0, 0, 0)
