"""Per-customer aggregates and lookups.

Each fact table is added up to one row per customer before anything is joined to it,
so no join here multiplies rows and a hot customer costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.amounts import margin_pct, number, total

COST_PARTS = ("compute_cost", "storage_cost", "support_cost")


def billed_by_customer(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("customer_id").agg(
        number(total("amount")).alias("billed_revenue_6m"), F.count(F.lit(1)).alias("invoices")
    )


def collected_by_customer(payments: DataFrame) -> DataFrame:
    return payments.groupBy("customer_id").agg(
        number(total("amount")).alias("cash_collected_6m"), F.count(F.lit(1)).alias("payments")
    )


def ar_by_customer(invoices: DataFrame) -> DataFrame:
    """Outstanding and overdue receivables, in one pass over the invoices."""
    status, amount = F.col("status"), F.col("amount")
    return invoices.groupBy("customer_id").agg(
        number(total(F.when(rules.outstanding(status), amount))).alias("ar_outstanding"),
        number(total(F.when(rules.overdue(status), amount))).alias("overdue_ar"),
    )


def cost_by_customer(costs: DataFrame) -> DataFrame:
    """Total cost and its components."""
    parts = [number(total(F.col(c))).alias(c) for c in COST_PARTS]
    return costs.groupBy("customer_id").agg(number(total("total_cost")).alias("cost_6m"), *parts)


def open_critical_cases(cases: DataFrame) -> DataFrame:
    critical = rules.open_critical(F.col("status"), F.col("severity"))
    return cases.groupBy("customer_id").agg(F.count_if(critical).alias("open_critical_cases"))


def gross_margin(invoices: DataFrame, costs: DataFrame) -> DataFrame:
    """Margin of each billed customer, unrounded; a customer without costs has 100."""
    cost = costs.groupBy("customer_id").agg(total("total_cost").alias("cost"))
    billed = invoices.groupBy("customer_id").agg(total("amount").alias("billed"))
    cost_or_0 = F.coalesce("cost", F.lit(0).cast("decimal(30,2)"))
    return billed.join(cost, "customer_id", "left").select(
        "customer_id",
        number(F.col("billed")).alias("billed_revenue_6m"),
        number(cost_or_0).alias("cost_6m"),
        margin_pct(F.col("billed"), cost_or_0).alias("gross_margin_pct"),
    )


def current_subscription(subscriptions: DataFrame) -> DataFrame:
    """The subscription each customer renews last, ties by the larger id.

    The greatest (renewal_date, id, ...) struct of the group: an aggregate, so it
    combines before the shuffle, which a row_number window would not.
    """
    rest = [c for c in subscriptions.columns if c not in ("customer_id", "renewal_date", "subscription_id")]
    latest = F.max(F.struct("renewal_date", "subscription_id", *rest)).alias("latest")
    return subscriptions.groupBy("customer_id").agg(latest).select("customer_id", "latest.*")


def next_forecast(forecasts: DataFrame) -> DataFrame:
    """The forecast with the earliest renewal date of each customer, ties by subscription id.
    A forecast without a date counts last."""
    fields = [
        "renewal_date", "subscription_id", "renewal_arr", "renewal_probability", "forecast_category",
        "risk_reason", "recommended_action",
    ]
    undated = F.col("renewal_date").isNull().alias("undated")
    earliest = F.min(F.struct(undated, *fields)).alias("next")
    return (
        forecasts.groupBy("customer_id")
        .agg(earliest)
        .select("customer_id", *[f"next.{f}" for f in fields])
    )


def forecast_lookup(customers: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every customer with its next forecast; one without is kept and marked."""
    found = next_forecast(forecasts).withColumn("has_forecast", F.lit(True))
    return customers.select("customer_id", "customer_name").join(found, "customer_id", "left").fillna(
        False, ["has_forecast"]
    )


def customer_ar_zero_fill(customers: DataFrame, invoices: DataFrame) -> DataFrame:
    """Receivables of every customer, 0 for one without invoices."""
    return (
        customers.select("customer_id", "customer_name")
        .join(ar_by_customer(invoices), "customer_id", "left")
        .fillna(0.0, ["ar_outstanding", "overdue_ar"])
    )


def invoices_nested(invoices: DataFrame) -> DataFrame:
    """The invoices of each customer and day as an array in the order of their ids.

    The grouping is the data's own, so no size changes it; a day bounds an array, whatever a
    customer has in all.
    """
    record = F.struct("invoice_id", "due_date", "amount", "status", "paid_date")
    return invoices.groupBy("customer_id", "invoice_date").agg(F.array_sort(F.collect_list(record)).alias("invoices"))
