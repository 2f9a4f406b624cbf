import datetime as dt

import pytest
from conftest import TERMS, day, rows
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import monthly
from ledgerlens.operators.quality import schema_differences
from ledgerlens.plans import questions, summary
from ledgerlens.schema import columns


@pytest.fixture(scope="module")
def profiles(company):
    return summary.customer_summary(company).cache()


@pytest.fixture(scope="module")
def by_id(profiles):
    return {r.customer_id: r for r in profiles.collect()}


def test_one_row_per_customer_in_declared_shape(profiles, by_id):
    assert schema_differences(profiles, "customer_finance_summary") == []
    assert sorted(by_id) == ["C1", "C2", "C3", "C4", "C5"]


def test_ordinary_customer(by_id):
    c1 = by_id["C1"]
    assert (c1.arr, c1.mrr, c1.billed_revenue_6m, c1.cash_collected_6m) == (1200.0, 100.0, 150.5, 100.0)
    assert (c1.ar_outstanding, c1.overdue_ar, c1.cost_6m) == (50.5, 0.0, 75.15)
    assert c1.gross_margin_pct == pytest.approx(50.07)
    assert (c1.latest_adoption_rate, c1.usage_trend_pct) == (0.6, 20.0)


def test_open_past_due_is_outstanding_not_overdue(by_id):
    assert (by_id["C1"].ar_outstanding, by_id["C1"].overdue_ar) == (50.5, 0.0)
    assert (by_id["C2"].ar_outstanding, by_id["C2"].overdue_ar) == (200.0, 200.0)


def test_only_open_and_critical_cases_count(by_id):
    assert by_id["C2"].open_critical_cases == 1
    assert by_id["C1"].open_critical_cases == 0


def test_customer_without_facts(by_id):
    c3 = by_id["C3"]
    assert (c3.arr, c3.billed_revenue_6m, c3.cost_6m, c3.open_critical_cases) == (0.0, 0.0, 0.0, 0)
    assert (c3.gross_margin_pct, c3.latest_adoption_rate, c3.usage_trend_pct) == (None, None, None)
    assert (c3.renewal_date, c3.renewal_probability, c3.risk_reason) == (None, None, None)


def test_several_subscriptions(by_id):
    c4 = by_id["C4"]
    assert c4.arr == 300.3, "active only, exact"
    assert (c4.renewal_date, c4.renewal_probability) == (day("2026-10-01"), 0.6)


def test_costs_without_billing_and_first_adoption_zero(by_id):
    c5 = by_id["C5"]
    assert (c5.cost_6m, c5.gross_margin_pct) == (7.0, None)
    assert (c5.latest_adoption_rate, c5.usage_trend_pct) == (0.3, None)


def test_margin_without_costs_is_100(by_id):
    assert by_id["C2"].gross_margin_pct == 100.0


def test_wanted_columns_equal_the_full_summary(company, profiles):
    for wanted in (["customer_id", "gross_margin_pct"], ["customer_id", "usage_trend_pct", "renewal_category"]):
        assert rows(summary.customer_summary(company, wanted)) == rows(profiles, *wanted)


def test_wanted_columns_read_only_their_tables(company):
    needed = {t: company[t] for t in ("customers", "invoices")}
    assert summary.customer_summary(needed, ["customer_id", "billed_revenue_6m"]).count() == 5


def test_layout_does_not_matter(company, profiles):
    moved = {t: df.repartition(7) for t, df in company.items()}
    assert rows(summary.customer_summary(moved)) == rows(profiles)


def test_summary_adds_up_to_the_facts(company, profiles):
    billed = profiles.agg(F.sum("billed_revenue_6m")).first()[0]
    assert billed == pytest.approx(company["invoices"].agg(F.sum("amount")).first()[0])


def test_portfolio(company, profiles):
    assert rows(summary.portfolio_totals(profiles, TERMS)) == [(360.5, 110.0, 250.5, 2400.0)]
    assert rows(summary.portfolio_counts(company["subscriptions"])) == [(4, 5, 3900.3)]
    assert rows(summary.active_arr(company["subscriptions"])) == [(3900.3, 5)]


def test_mrr_rounds_half_up(spark):
    # 0.30 / 12 is exactly half a cent above 0.02.
    df = spark.createDataFrame([(0.30,), (100.0,), (0.18,)], "arr double")
    assert [float(r[0]) for r in df.select(monthly(F.col("arr"))).collect()] == [0.03, 8.33, 0.02]


# --- questions ---------------------------------------------------------------


def names(df):
    return [r.customer_name for r in df.select("customer_name").collect()]


def test_at_risk_is_strictly_below(profiles):
    assert names(questions.at_risk(profiles, TERMS)) == ["Name 5", "Name 2"]


def test_bands(company):
    bands = {r.band: r.renewals for r in questions.renewal_bands(company["renewal_forecasts"], TERMS).collect()}
    assert bands == {"at_risk": 2, "watch": 1, "healthy": 2}, "0.60 is watch, 0.75 is healthy"
    assert questions.watch_renewals(company["renewal_forecasts"], TERMS).count() == 1


def test_band_of_unknown_probability_is_null(make):
    unknown = make("renewal_forecasts", {"forecast_id": "F", "renewal_arr": 5.0})
    assert rows(questions.renewal_bands(unknown, TERMS)) == [(None, 1, 5.0)]


def test_trend_of_exactly_minus_ten_is_not_declining(make):
    two = make(
        "customer_finance_summary",
        {"customer_id": "A", "usage_trend_pct": -10.0},
        {"customer_id": "B", "usage_trend_pct": -10.01},
        {"customer_id": "N"},
    )
    assert rows(questions.declining_adoption(two, TERMS), "customer_id") == [("B",)]


def test_declining_with_critical_case(profiles):
    assert names(questions.declining_critical(profiles, TERMS)) == ["Name 2"]


def test_renewal_window_includes_its_last_day(company, profiles):
    assert TERMS.as_of + dt.timedelta(90) == day("2026-11-29")
    assert rows(questions.renewals_due(company["renewal_forecasts"], TERMS), "subscription_id") == [("S2",), ("S4b",)]
    assert names(questions.urgent_renewals(profiles, TERMS)) == ["Name 2"]


def test_profitability_puts_unknown_margins_last(profiles):
    assert names(questions.profitability(profiles)) == ["Name 1", "Name 2", "Name 4", "Name 3", "Name 5"]


def test_overdue_invoices_with_forecast(company):
    assert rows(questions.overdue_with_forecast(company), "invoice_id", "renewal_probability") == [("I3", 0.59)]
    assert rows(questions.overdue_at_risk(company, TERMS), "invoice_id") == [("I3",)]


def test_margin_drivers(company, profiles):
    found = questions.margin_drivers(profiles, company["cloud_costs"], k=2).collect()
    assert [(r.customer_id, r.compute_share) for r in sorted(found)] == [("C1", 1.0), ("C2", None)]


def test_evidence_and_unexplained_risk(profiles):
    found = {r.customer_id: r.drivers for r in questions.forecast_evidence(profiles, TERMS).collect()}
    assert found["C2"] == 3
    assert rows(questions.unexplained_risk(profiles, TERMS), "customer_id") == [("C5",)]


def test_next_actions_never_invent(profiles):
    action = {r.customer_id: r for r in questions.next_actions(profiles, TERMS).collect()}
    assert action["C5"].usage_trend_pct is None
    assert action["C2"].recommended_action == "action S2"


def test_briefing(profiles):
    found = {r.band: (r.customers, r.arr, r.overdue_ar) for r in questions.executive_briefing(profiles, TERMS).collect()}
    assert found["at_risk"] == (2, 2400.0, 200.0)
    assert found[None] == (1, 0.0, 0.0)


def test_expansion_and_segment(company, profiles):
    assert names(questions.expansion_candidates(profiles)) == ["Name 1"]
    segments = {r.segment: (r.customers, r.arr) for r in questions.rollup_by(profiles, company["customers"], "segment").collect()}
    assert segments == {"Big": (2, 3600.0), "Small": (3, 300.3)}


def test_summary_columns_are_nineteen():
    assert len(columns("customer_finance_summary")) == 19
