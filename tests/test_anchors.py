"""Two customers by hand, from CSV files to the portfolio and the questions."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest

from ledgerlens.operators import quality
from ledgerlens.plans import questions, summary
from ledgerlens.schema import TABLES, Terms
from ledgerlens.sources import files, tables

TERMS = Terms(as_of=dt.date(2025, 6, 30))

LANDED = {
    "customers": """customer_id,customer_name,industry,country,segment,account_owner
A,"Alder, Inc.",Retail,NO,Large,Kim
B,"Birch
Brothers",Energy,SE,Small,Lee
""",
    "products": """product_id,product_name,product_family,list_price_arr
P,Platform,Core,12000.00
""",
    "subscriptions": """subscription_id,customer_id,product_id,arr,start_date,renewal_date,licensed_users,contract_tier,status
SA,A,P,120000.00,2024-01-01,2025-12-31,100,Gold,Active
SB,B,P,36000.50,2024-03-01,2025-08-31,40,Basic,Active
""",
    "invoices": """invoice_id,customer_id,subscription_id,invoice_date,due_date,amount,status,paid_date
I1,A,SA,2025-04-01,2025-04-30,10000.00,Paid,2025-04-20
I2,A,SA,2025-05-01,2025-05-30,10000.00,Paid,2025-05-29
I3,A,SA,2025-06-01,2025-06-30,10000.00,Open,
I4,B,SB,2025-04-01,2025-04-30,3000.04,Paid,2025-04-30
I5,B,SB,2025-05-01,2025-05-30,3000.04,Overdue,
""",
    "payments": """payment_id,invoice_id,customer_id,payment_date,amount,payment_method
Y1,I1,A,2025-04-20,10000.00,transfer
Y2,I2,A,2025-05-29,10000.00,transfer
Y4,I4,B,2025-04-30,3000.04,card
""",
    "usage_monthly": """usage_id,subscription_id,customer_id,usage_month,licensed_users,active_users,adoption_rate,compute_hours,production_jobs
UA4,SA,A,2025-04-01,100,60,0.6,200.0,10
UA5,SA,A,2025-05-01,100,66,0.66,210.0,12
UB4,SB,B,2025-04-01,40,32,0.8,90.0,4
UB5,SB,B,2025-05-01,40,24,0.6,80.0,3
UB6,SB,B,2025-06-01,40,20,0.5,70.0,2
""",
    "support_cases": '''case_id,customer_id,subscription_id,severity,status,case_title,opened_date,resolved_date,support_hours
K1,B,SB,Critical,Open,"Jobs ""hang""",2025-06-10,,4.5
K2,A,SA,Low,Resolved,Question,2025-05-02,2025-05-04,0.5
''',
    "cloud_costs": """cost_id,subscription_id,customer_id,cost_month,compute_cost,storage_cost,support_cost,total_cost
CA4,SA,A,2025-04-01,4000.00,1000.00,1000.00,6000.00
CB4,SB,B,2025-04-01,2000.00,700.02,800.02,3500.04
""",
    "renewal_forecasts": """forecast_id,subscription_id,customer_id,renewal_date,renewal_arr,renewal_probability,forecast_category,risk_reason,recommended_action
FA,SA,A,2025-12-31,120000.00,0.92,Expansion,None,Expand
FB,SB,B,2025-08-31,36000.50,0.41,At Risk,Usage falls,Review
""",
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    landing, root = tmp_path_factory.mktemp("landing"), str(tmp_path_factory.mktemp("warehouse"))
    for name, text in LANDED.items():
        (landing / f"{name}.csv").write_text(text)
    raw = {t: files.read_csv(spark, str(landing / f"{t}.csv"), t) for t in TABLES[:-1]}
    assert sum(files.rejected(df, t).count() for t, df in raw.items()) == 0
    summary.load_checked({t: files.accepted(df, t) for t, df in raw.items()}, root, TERMS)
    return tables.read_tables(spark, root)


def test_profiles(loaded):
    alder, birch = sorted(loaded["customer_finance_summary"].collect())
    assert (alder.customer_name, birch.customer_name) == ("Alder, Inc.", "Birch\nBrothers")
    assert (alder.arr, alder.mrr, birch.arr, birch.mrr) == (120000.0, 10000.0, 36000.5, 3000.04)
    assert (alder.billed_revenue_6m, alder.cash_collected_6m, alder.ar_outstanding, alder.overdue_ar) == (30000.0, 20000.0, 10000.0, 0.0)
    assert (birch.billed_revenue_6m, birch.cash_collected_6m, birch.ar_outstanding, birch.overdue_ar) == (6000.08, 3000.04, 3000.04, 3000.04)
    assert (alder.cost_6m, alder.gross_margin_pct, birch.cost_6m, birch.gross_margin_pct) == (6000.0, 80.0, 3500.04, 41.67)
    assert (alder.latest_adoption_rate, alder.usage_trend_pct, birch.latest_adoption_rate, birch.usage_trend_pct) == (0.66, 10.0, 0.5, -37.5)
    assert (alder.open_critical_cases, birch.open_critical_cases) == (0, 1)


def test_portfolio_and_report(loaded, tmp_path):
    totals = summary.portfolio_totals(loaded["customer_finance_summary"], TERMS).first()
    assert tuple(totals) == (36000.08, 23000.04, 13000.04, 36000.5)
    path = str(tmp_path / "report")
    files.export_document(quality.report_document(quality.quality_report(loaded, TERMS)), path)
    (document,) = [json.loads(x) for f in os.listdir(path) if f.startswith("part") for x in open(os.path.join(path, f))]
    assert all(document["checks"].values()) and sum(document["table_rows"].values()) == 26
    assert document["billed_revenue_6m"] == 36000.08


def test_questions(loaded):
    profiles = loaded["customer_finance_summary"]
    (risky,) = questions.at_risk(profiles, TERMS).collect()
    assert (risky.customer_name, risky.arr, risky.renewal_probability, risky.overdue_ar, risky.recommended_action) == (
        "Birch\nBrothers", 36000.5, 0.41, 3000.04, "Review",
    )
    (urgent,) = questions.urgent_renewals(profiles, TERMS).collect()
    assert urgent.customer_id == "B" and urgent.renewal_date == dt.date(2025, 8, 31)
    (streak,) = questions.long_decline_streaks(loaded["usage_monthly"]).collect()
    assert (streak.subscription_id, streak.decline_streak) == ("SB", 2)
    (overdue,) = questions.overdue_with_forecast(loaded).collect()
    assert overdue.invoice_id == "I5"
