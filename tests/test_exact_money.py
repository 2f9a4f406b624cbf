"""Amounts that a double times ten thousand cannot hold, from an invoice to the portfolio."""

from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import cents, exact_sum, monthly, total
from ledgerlens.operators import quality
from ledgerlens.plans import summary
from tests.conftest import TERMS, day

LARGE = 123456789012345.67


def amounts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "amount double")


@pytest.mark.parametrize(
    "values", [[LARGE], [LARGE, 0.01, -0.02], [9.4e14, 9.4e14], [1e17, 1e17, 0.05], [-LARGE] * 9, [9007199254.7409, 900719925474.09, 900719925474.1], [0.1] * 10, []]
)
def test_sums_are_the_sums_of_the_written_numbers(spark, values):
    got = amounts(spark, *values, None).agg(exact_sum("amount").alias("e"), total("amount").alias("t")).first()
    want = sum((Decimal(repr(v)) for v in values), Decimal(0))
    assert got["e"] == (want if values else None) and got["t"] == round(want, 2)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**17), 10**17), st.integers(0, 4)), min_size=1, max_size=40))
def test_any_sum_is_exact(spark, pairs):
    values = [float(n) / 10**places for n, places in pairs]
    got = amounts(spark, *values).agg(exact_sum("amount")).first()[0]
    assert got == sum(Decimal(repr(v)).quantize(Decimal("0.0001"), "ROUND_HALF_UP") for v in values)


def test_row_amounts_keep_their_cents(spark):
    row = amounts(spark, LARGE).select(cents("amount").alias("c"), monthly(F.col("amount") * 12).alias("m")).first()
    assert row["c"] == LARGE and row["m"] == round(Decimal(repr(LARGE * 12)) / 12, 2)


@pytest.fixture(scope="module")
def rich(make, company):
    """A company whose invoices are as large as doubles with cents can be."""
    base = {"customer_id": "C1", "subscription_id": "S1", "invoice_date": day("2026-08-01"), "due_date": day("2026-08-30")}
    invoices = make(
        "invoices",
        {**base, "invoice_id": "I1", "amount": LARGE, "status": "Paid", "paid_date": day("2026-08-25")},
        {**base, "invoice_id": "I2", "amount": 9.4e14, "status": "Open"},
        {**base, "invoice_id": "I3", "amount": 0.01, "status": "Overdue", "customer_id": "C2", "subscription_id": "S2"},
    )
    payments = make("payments", {"payment_id": "P1", "invoice_id": "I1", "customer_id": "C1", "amount": LARGE})
    return {**company, "invoices": invoices, "payments": payments}


def test_portfolio_loses_nothing(rich):
    carried = summary.customer_summary(rich, carried=True)
    got = summary.portfolio_amounts(carried, TERMS).first()
    assert got["billed_revenue_6m"] == Decimal("1063456789012345.68")
    assert got["cash_collected_6m"] == Decimal("123456789012345.67")
    assert got["ar_outstanding"] == Decimal("940000000000000.01")
    assert got["at_risk_arr"] == Decimal("2400.00")
    shown = summary.portfolio_totals(summary.customer_summary(rich), TERMS).first()
    assert shown["cash_collected_6m"] == LARGE


def test_reconciliation_sees_a_cent_in_a_large_total(rich):
    dfs = summary.with_summary(rich, carried=True)
    assert all(f(dfs).first()["holds"] for f in (quality.reconcile_billed, quality.reconcile_outstanding, quality.reconcile_cash))
    short = {**dfs, "invoices": rich["invoices"].filter("invoice_id <> 'I3'")}
    assert not quality.reconcile_billed(short).first()["holds"]
    assert not quality.reconcile_outstanding(short).first()["holds"]
