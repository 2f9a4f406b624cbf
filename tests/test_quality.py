import datetime as dt

import pytest
from conftest import TERMS, day, rows

from ledgerlens.operators import quality
from ledgerlens.plans.summary import with_summary
from ledgerlens.schema import FOREIGN_KEYS, TABLES
from ledgerlens.sources.tables import staged_tables


@pytest.fixture(scope="module")
def complete(company):
    return with_summary(company)


def orphans(dfs):
    return {(r.child, r.column): r.orphans for r in quality.fk_report(dfs).collect()}


def test_fourteen_checks_all_listed(company):
    found = orphans(company)
    assert len(found) == len(FOREIGN_KEYS) == 14
    assert found.pop(("support_cases", "subscription_id")) == 4, "the cases name no subscription"
    assert set(found.values()) == {0}


def test_orphan_and_null_keys_count(company, make):
    broken = {
        **company,
        "payments": make(
            "payments",
            {"payment_id": "1", "invoice_id": "I1", "customer_id": "C1"},
            {"payment_id": "2", "invoice_id": "nowhere", "customer_id": None},
            {"payment_id": "3", "invoice_id": "nowhere", "customer_id": "C1"},
        ),
    }
    found = orphans(broken)
    assert found[("payments", "invoice_id")] == 2
    assert found[("payments", "customer_id")] == 1
    key = next(k for k in FOREIGN_KEYS if (k.child, k.column) == ("payments", "invoice_id"))
    assert rows(quality.fk_orphans(broken["payments"], broken["invoices"], key), "payment_id") == [("2",), ("3",)]


def test_empty_tables_still_report(company, make):
    empty = {t: make(t) for t in company}
    assert orphans(empty) == {(k.child, k.column): 0 for k in FOREIGN_KEYS}


def test_duplicate_keys_and_grain(company, make, complete):
    twice = make(
        "usage_monthly",
        {"usage_id": "U1", "subscription_id": "S", "usage_month": day("2026-01-01")},
        {"usage_id": "U2", "subscription_id": "S", "usage_month": day("2026-01-01")},
        {"usage_id": "U2", "subscription_id": "S", "usage_month": day("2026-02-01")},
    )
    found = quality.duplicate_keys({**complete, "usage_monthly": twice})
    assert rows(found, "table_name", "key_columns", "copies") == [
        ("usage_monthly", "subscription_id,usage_month", 2),
        ("usage_monthly", "usage_id", 2),
    ]
    assert quality.duplicate_keys(complete).count() == 0


def test_cardinality(complete, company, make):
    found = {r.relationship: r for r in quality.relationship_cardinality(complete).collect()}
    assert len(found) == 9
    assert (found["owns"].max_targets, found["owns"].without_target) == (3, 1)
    assert all(r.violations == 0 for r in found.values())
    doubled = {**complete, "renewal_forecasts": company["renewal_forecasts"].union(
        make("renewal_forecasts", {"forecast_id": "again", "subscription_id": "S1"}))}
    found = {r.relationship: r for r in quality.relationship_cardinality(doubled).collect()}
    assert found["has"].violations == 1


def test_every_table_is_read_once_and_grouped_once(complete):
    stored = staged_tables(complete, quality.key_columns())
    for report in (quality.fk_report, quality.duplicate_keys, quality.key_report, quality.entity_degree, quality.relationship_cardinality):
        physical = report(stored)._jdf.queryExecution().sparkPlan().toString()
        assert physical.count("Scan parquet") == len(TABLES), report
        executed = report(stored)._jdf.queryExecution().executedPlan().toString()
        assert executed.count("Exchange hashpartitioning(space") == 1, report


def test_reports_share_one_grouping(complete):
    counts = quality.key_counts(complete)
    assert rows(quality.fk_report({}, counts)) == rows(quality.fk_report(complete))
    assert rows(quality.key_report({}, counts)) == rows(quality.key_report(complete))
    assert rows(quality.duplicate_keys({}, counts)) == []
    assert rows(quality.entity_degree({}, counts)) == rows(quality.entity_degree(complete))


def test_null_and_hot_keys(company, make):
    null = {**company, "customers": company["customers"].union(make("customers", {}, {}))}
    assert orphans(null)["payments", "customer_id"] == 0
    found = {(r.table_name, r.key): r.copies for r in quality.duplicate_keys(null).collect()}
    assert found == {("customers", None): 2}


def test_degree_lists_zero(complete):
    degree = {(r.relationship, r.source_key): r.degree for r in quality.entity_degree(complete).collect()}
    assert degree[("receives", "C1")] == 2
    assert degree[("receives", "C3")] == 0


def test_reconciliation_holds(complete):
    assert rows(quality.reconcile_billed(complete)) == [("billed", 360.5, 360.5, True)]
    assert rows(quality.reconcile_outstanding(complete)) == [("outstanding", 250.5, 250.5, True)]
    assert rows(quality.reconcile_cash(complete)) == [("cash", 250.5, 250.5, True)]
    assert {r.difference for r in quality.reconcile_cash_by_customer(complete).collect()} == {0.0}


def test_lost_payment_breaks_the_gate(complete):
    lost = {**complete, "payments": complete["payments"].filter("payment_id <> 'P-4'")}
    assert rows(quality.reconcile_cash(lost), "holds") == [(False,)]
    broken = quality.reconcile_cash_by_customer(lost).filter("difference <> 0")
    assert rows(broken, "customer_id", "difference") == [("C4", 10.0)]
    with pytest.raises(quality.QualityError, match="check:cash: 10.0"):
        quality.assert_quality(quality.quality_report(lost, TERMS))


def test_report_of_good_tables(complete, make):
    cases = complete["support_cases"].fillna("S1", ["subscription_id"])
    report = quality.assert_quality(quality.quality_report({**complete, "support_cases": cases}, TERMS))
    found = {r.metric: r for r in report.collect()}
    assert found["rows:customers"].value == 5
    assert found["at_risk_arr"].value == 200.0
    assert found["as_of_date"].text == "2026-08-31"
    assert sum(m.startswith("rows:") for m in found) == len(TABLES)


def test_category_against_band(company):
    found = quality.category_band_mismatch(company["renewal_forecasts"], TERMS)
    assert rows(found, "subscription_id", "forecast_category", "band") == [("S2", "Watch", "at_risk")]


def test_schema_conformance(company):
    for table, df in company.items():
        assert quality.schema_differences(df, table) == []
    turned = company["products"].select("product_name", "product_id", "product_family", "list_price_arr")
    assert quality.schema_differences(turned, "products") == ["column order"]
    assert "missing arr double" in quality.schema_differences(company["subscriptions"].drop("arr"), "subscriptions")


def test_as_of_is_a_parameter():
    assert TERMS.as_of == dt.date(2026, 8, 31)
