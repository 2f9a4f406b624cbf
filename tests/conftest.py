"""One local session for all tests, and small finance tables made by hand."""

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import session  # noqa: E402
from ledgerlens.schema import SCHEMAS, Terms  # noqa: E402

TERMS = Terms(as_of=dt.date(2026, 8, 31))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return session(cpus=8, partitions=4, spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def make(spark):
    """``make("invoices", {...}, ...)``: a registry table of the given rows, the rest null."""

    def build(table: str, *rows: dict):
        names = SCHEMAS[table].fieldNames()
        for row in rows:
            assert set(row) <= set(names), row
        return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], SCHEMAS[table])

    return build


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *columns: str) -> list[tuple]:
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


@pytest.fixture(scope="session")
def company(make):
    """A table set with the edge cases.

    C1 ordinary and healthy; C2 declining, with an open critical case and overdue; C3
    without any fact; C4 with two subscriptions and two forecasts; C5 billed nothing but
    with costs, adoption starting at 0.
    """
    customers = make(
        "customers",
        *[
            {"customer_id": f"C{i}", "customer_name": f"Name {i}", "segment": "Big" if i < 3 else "Small"}
            for i in range(1, 6)
        ],
    )
    products = make("products", {"product_id": "P1", "product_name": "Product"})

    def sub(sid, cid, arr, status="Active", renewal="2026-12-31"):
        return {
            "subscription_id": sid, "customer_id": cid, "product_id": "P1", "arr": arr, "status": status,
            "renewal_date": day(renewal), "licensed_users": 10, "contract_tier": "Gold",
        }

    subscriptions = make(
        "subscriptions",
        sub("S1", "C1", 1200.0),
        sub("S2", "C2", 2400.0),
        sub("S4a", "C4", 100.1),
        sub("S4b", "C4", 200.2),
        sub("S4c", "C4", 999.0, status="Lapsed"),
        sub("S5", "C5", 0.0),
    )

    def invoice(iid, cid, sid, amount, status, paid=None, due="2026-08-30"):
        return {
            "invoice_id": iid, "customer_id": cid, "subscription_id": sid, "amount": amount, "status": status,
            "invoice_date": day("2026-08-01"), "due_date": day(due), "paid_date": paid and day(paid),
        }

    invoices = make(
        "invoices",
        invoice("I1", "C1", "S1", 100.0, "Paid", "2026-08-25"),
        invoice("I2", "C1", "S1", 50.5, "Open"),
        invoice("I3", "C2", "S2", 200.0, "Overdue"),
        invoice("I4", "C4", "S4a", 10.0, "Paid", "2026-08-20"),
    )

    def payment(pid, iid, cid, amount):
        return {"payment_id": pid, "invoice_id": iid, "customer_id": cid, "amount": amount}

    payments = make("payments", payment("P-1", "I1", "C1", 100.0), payment("P-4", "I4", "C4", 10.0))

    def use(sid, cid, month, rate, hours=10.0):
        return {
            "usage_id": f"{sid}-{month}", "subscription_id": sid, "customer_id": cid, "usage_month": day(month),
            "adoption_rate": rate, "compute_hours": hours, "licensed_users": 10, "active_users": round(rate * 10),
        }

    usage = make(
        "usage_monthly",
        use("S1", "C1", "2026-06-01", 0.5),
        use("S1", "C1", "2026-07-01", 0.6),
        use("S2", "C2", "2026-06-01", 0.8),
        use("S2", "C2", "2026-07-01", 0.7),
        use("S2", "C2", "2026-08-01", 0.4),
        use("S5", "C5", "2026-06-01", 0.0),
        use("S5", "C5", "2026-07-01", 0.3),
    )

    def case(cid, who, severity, status):
        return {"case_id": cid, "customer_id": who, "severity": severity, "status": status, "case_title": "t"}

    cases = make(
        "support_cases",
        case("K1", "C2", "Critical", "Open"),
        case("K2", "C2", "Critical", "Resolved"),
        case("K3", "C2", "High", "Open"),
        case("K4", "C1", "Low", "Open"),
    )

    def cost(sid, cid, month, amount):
        return {
            "cost_id": f"COST-{sid}-{month}", "subscription_id": sid, "customer_id": cid, "cost_month": day(month),
            "compute_cost": amount, "storage_cost": 0.0, "support_cost": 0.0, "total_cost": amount,
        }

    costs = make(
        "cloud_costs",
        cost("S1", "C1", "2026-06-01", 30.0),
        cost("S1", "C1", "2026-07-01", 45.15),
        cost("S5", "C5", "2026-06-01", 7.0),
    )

    def forecast(sid, cid, p, category, renewal="2026-12-31", arr=100.0):
        return {
            "forecast_id": f"RF-{sid}", "subscription_id": sid, "customer_id": cid, "renewal_probability": p,
            "forecast_category": category, "renewal_date": day(renewal), "renewal_arr": arr,
            "risk_reason": f"reason {sid}", "recommended_action": f"action {sid}",
        }

    forecasts = make(
        "renewal_forecasts",
        forecast("S1", "C1", 0.75, "Expansion"),
        forecast("S2", "C2", 0.59, "Watch", "2026-11-29"),
        forecast("S4a", "C4", 0.9, "Likely", "2027-03-01"),
        forecast("S4b", "C4", 0.6, "Watch", "2026-10-01"),
        forecast("S5", "C5", 0.1, "At Risk", "2026-11-30"),
    )
    return {
        "customers": customers, "products": products, "subscriptions": subscriptions, "invoices": invoices,
        "payments": payments, "usage_monthly": usage, "support_cases": cases, "cloud_costs": costs,
        "renewal_forecasts": forecasts,
    }
