"""A directory of the ten tables as CSV, named by SAMPLE_CSV_DIR, taken from end to end:
the summary computed from its facts must equal the summary it comes with."""

import os

import pytest
from conftest import TERMS, rows

from ledgerlens.operators import quality
from ledgerlens.plans import questions, summary
from ledgerlens.schema import TABLES
from ledgerlens.sources import files

PATH = os.environ.get("SAMPLE_CSV_DIR", "")
pytestmark = pytest.mark.skipif(not PATH, reason="SAMPLE_CSV_DIR is not set")


@pytest.fixture(scope="module")
def sample(spark):
    raw = {t: files.read_csv(spark, f"{PATH}/{t}.csv", t) for t in TABLES}
    assert all(files.rejected(df, t).count() == 0 for t, df in raw.items())
    return {t: files.accepted(df, t) for t, df in raw.items()}


def test_summary_equals_the_given_one(sample):
    assert rows(summary.customer_summary(sample)) == rows(sample["customer_finance_summary"])


def test_gate_passes(sample):
    report = quality.assert_quality(quality.quality_report(sample, TERMS))
    found = {r.metric: r.value for r in report.collect()}
    assert found["billed_revenue_6m"] == 2_214_000
    assert found["cash_collected_6m"] == 2_047_500
    assert found["ar_outstanding"] == 166_500
    assert found["at_risk_arr"] == 948_000
    assert quality.duplicate_keys(sample).count() == 0
    assert {r.violations for r in quality.relationship_cardinality(sample).collect()} == {0}


def test_questions(sample):
    profiles = summary.customer_summary(sample).cache()
    assert [r.renewal_probability for r in questions.at_risk(profiles, TERMS).collect()] == [0.35, 0.48, 0.58]
    assert questions.declining_critical(profiles, TERMS).count() == 2
    assert questions.urgent_renewals(profiles, TERMS).count() == 2
    assert questions.profitability(profiles).first().gross_margin_pct == 44.55
    assert rows(questions.overdue_at_risk(sample, TERMS), "invoice_id") == [("INV0011",), ("INV0023",)]
    assert questions.unexplained_risk(profiles, TERMS).count() == 0
    assert questions.expansion_candidates(profiles).count() == 2
    assert questions.long_decline_streaks(sample["usage_monthly"], 5).count() == 5
    assert quality.category_band_mismatch(sample["renewal_forecasts"], TERMS).count() == 2
    briefing = {r.band: (r.customers, r.arr) for r in questions.executive_briefing(profiles, TERMS).collect()}
    assert briefing == {"at_risk": (3, 948_000.0), "watch": (2, 744_000.0), "healthy": (7, 2_736_000.0)}
    segments = {r.segment: r.arr for r in questions.rollup_by(profiles, sample["customers"], "segment").collect()}
    assert segments == {"Enterprise": 2_400_000.0, "Strategic": 1_320_000.0, "Commercial": 708_000.0}


def test_softening_usage_with_rising_unit_cost(sample):
    from ledgerlens.operators.costs import paired_periods

    paired = paired_periods(sample["cloud_costs"], sample["usage_monthly"])
    trend = summary.customer_summary(sample)
    found = questions.usage_down_cost_up(trend, sample["subscriptions"], paired, TERMS)
    assert found.count() == 5
