"""Tables stored by customer: the same summary without a shuffle, months pruned."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows

from ledgerlens.plans import summary
from ledgerlens.sources import tables


@pytest.fixture(scope="module")
def stored(spark, company, tmp_path_factory):
    dfs = {t: df for t, df in company.items() if "customer_id" in df.columns}
    names = tables.store_by_customer(dfs, "kept", str(tmp_path_factory.mktemp("by_customer")), buckets=4)
    yield {t: spark.table(n) for t, n in names.items()}
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def shuffled_joins(spark):
    """No join is small enough to be broadcast, as with tables of any size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_is_the_same_without_a_shuffle(company, stored, shuffled_joins):
    found = summary.customer_summary(stored, by_customer=True)
    assert "Exchange" not in plan(found)
    assert rows(found) == rows(summary.customer_summary(company))
    assert "Exchange" in plan(summary.customer_summary(company))


def test_months_are_pruned(stored, shuffled_joins):
    august = {"invoices": tables.in_months(stored["invoices"], dt.date(2026, 8, 1), dt.date(2026, 8, 1)),
              "cloud_costs": tables.in_months(stored["cloud_costs"], dt.date(2026, 6, 1), dt.date(2026, 6, 1))}
    found = summary.measures_of(august, "invoices").join(summary.measures_of(august, "cloud_costs"), "customer_id", "full")
    text = plan(found)
    assert "Exchange" not in text and text.count(f"PartitionFilters: [isnotnull({tables.MONTH}") == 2
    assert sorted((r.customer_id, float(r.cost or 0)) for r in found.collect()) == [("C1", 30.0), ("C2", 0.0), ("C4", 0.0), ("C5", 7.0)]
    files = stored["cloud_costs"].filter(f"{tables.MONTH} = DATE '2026-07-01'").inputFiles()
    assert files and all(f"{tables.MONTH}=2026-07-01" in f for f in files)


def test_a_bucket_is_one_file_a_month(stored):
    files = [f.rsplit("/", 1) for f in stored["usage_monthly"].inputFiles()]
    buckets = [(folder, name.split("_")[-1].split(".")[0]) for folder, name in files]
    assert len(buckets) == len(set(buckets))
