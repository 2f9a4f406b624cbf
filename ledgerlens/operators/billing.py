"""Billing: schedules, amounts, settlement, payments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import exact, exact_sum, monthly, number
from ledgerlens.functions.identifiers import cyclic
from ledgerlens.functions.rules import PAID, ar_class

def billing_schedule(subscriptions: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per subscription per month from ``start`` to ``end``, both included."""
    months = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 month"))
    return subscriptions.select(
        "subscription_id",
        "customer_id",
        number(monthly(F.col("arr"))).alias("amount"),
        F.explode(months).alias("invoice_date"),
    )


def with_mrr(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.withColumn("mrr", number(monthly(F.col("arr"))))


def with_due_date(invoices: DataFrame, days: int = 29) -> DataFrame:
    return invoices.withColumn("due_date", F.date_add("invoice_date", days))


def with_settlement(invoices: DataFrame, days_early: Column) -> DataFrame:
    """The paid date, some days before the due date, for paid invoices only."""
    paid_date = F.date_sub("due_date", days_early.cast("int"))
    return invoices.withColumn("paid_date", F.when(F.col("status") == PAID, paid_date))


def with_ar_class(invoices: DataFrame) -> DataFrame:
    return invoices.withColumn("ar_class", ar_class(F.col("status")))


def payments_from_invoices(invoices: DataFrame, method_index: Column, methods: Sequence[str]) -> DataFrame:
    """One payment per paid invoice, on its paid date, ``methods`` in turn by ``method_index``."""
    return invoices.filter(F.col("status") == PAID).select(
        F.concat(F.lit("PAY-"), "invoice_id").alias("payment_id"),
        "invoice_id",
        "customer_id",
        F.col("paid_date").alias("payment_date"),
        "amount",
        cyclic(method_index, list(methods)).alias("payment_method"),
    )


def match_payments(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Every invoice id with its billed and paid amount and how the two match.

    Payments are added up per invoice first, so several for one invoice show as
    ``several_payments`` and do not multiply rows.
    """
    billed = invoices.select("invoice_id", "status", exact("amount").alias("billed"))
    paid = payments.groupBy("invoice_id").agg(
        exact_sum("amount").alias("paid"), F.count(F.lit(1)).alias("payments")
    )
    is_paid = F.col("status").eqNullSafe(PAID)
    match = (
        F.when(F.col("billed").isNull(), "payment_without_invoice")
        .when(~is_paid & F.col("paid").isNull(), "unpaid")
        .when(~is_paid, "payment_of_unpaid_invoice")
        .when(F.col("paid").isNull(), "paid_without_payment")
        .when(F.col("payments") > 1, "several_payments")
        .when(F.col("billed") != F.col("paid"), "amount_differs")
        .otherwise("matched")
    )
    return billed.join(paid, "invoice_id", "full_outer").select(
        "invoice_id",
        "status",
        number(F.col("billed")).alias("billed"),
        number(F.col("paid")).alias("paid"),
        match.alias("match"),
    )


def invoice_payment_mismatch(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    return match_payments(invoices, payments).filter(~F.col("match").isin("matched", "unpaid"))
