"""Row-level joins across the finance keys. They keep every fact row; a hot key's partition
is split by adaptive execution, so no key is counted and no input read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.amounts import number, total
from ledgerlens.schema import Terms


def invoice_360(dfs: dict[str, DataFrame]) -> DataFrame:
    """Invoices with their customer, subscription, product and payment.

    The dimension side is put together first, one row per subscription, and joined to
    the invoices once.
    """
    product = dfs["products"].select("product_id", "product_name", "product_family")
    subscription = dfs["subscriptions"].select("subscription_id", "product_id", "contract_tier").join(product, "product_id", "left")
    customer = dfs["customers"].select("customer_id", "customer_name", "segment")
    paid = dfs["payments"].groupBy("invoice_id").agg(
        number(total("amount")).alias("paid_amount"), F.max("payment_date").alias("last_payment_date")
    )
    wide = dfs["invoices"].join(subscription, "subscription_id", "left").join(customer, "customer_id", "left")
    return wide.join(paid, "invoice_id", "left").select(
        "invoice_id", "customer_id", "customer_name", "segment", "subscription_id", "contract_tier",
        "product_id", "product_name", "product_family", "invoice_date", "due_date", "amount", "status",
        "paid_amount", "last_payment_date",
    )


def at_risk_invoices(invoices: DataFrame, forecasts: DataFrame, terms: Terms) -> DataFrame:
    """Invoices of subscriptions with an at-risk renewal."""
    risky = forecasts.filter(rules.at_risk(F.col("renewal_probability"), terms)).select("subscription_id")
    return invoices.join(risky, "subscription_id", "left_semi")


def overdue_forecast(dfs: dict[str, DataFrame]) -> DataFrame:
    """Overdue invoices with customer name and renewal forecast."""
    overdue = (
        dfs["invoices"]
        .filter(rules.overdue(F.col("status")))
        .select("invoice_id", "customer_id", "subscription_id", "amount", "due_date")
    )
    forecast = dfs["renewal_forecasts"].select(
        "subscription_id", "renewal_date", "renewal_probability", "forecast_category"
    )
    named = overdue.join(dfs["customers"].select("customer_id", "customer_name"), "customer_id")
    return named.join(forecast, "subscription_id").select(
        "customer_name", "invoice_id", "amount", "due_date", "renewal_date", "renewal_probability",
        "forecast_category",
    )
