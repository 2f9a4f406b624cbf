"""Governed business rules as boolean and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import Terms

PAID, OPEN, OVERDUE = "Paid", "Open", "Overdue"


def at_risk(probability: Column, terms: Terms) -> Column:
    return probability < terms.at_risk_below


def watch(probability: Column, terms: Terms) -> Column:
    return (probability >= terms.at_risk_below) & (probability < terms.watch_below)


def renewal_band(probability: Column, terms: Terms) -> Column:
    """at_risk, watch or healthy by probability; null stays null."""
    return (
        F.when(at_risk(probability, terms), "at_risk")
        .when(watch(probability, terms), "watch")
        .when(probability.isNotNull(), "healthy")
    )


def band_of_category(category: Column) -> Column:
    """The band a forecast category claims: At Risk and Watch name theirs, any
    other category claims a healthy renewal."""
    return (
        F.when(category == "At Risk", "at_risk")
        .when(category == "Watch", "watch")
        .when(category.isNotNull(), "healthy")
    )


def declining(trend: Column, terms: Terms) -> Column:
    return trend < terms.declining_below


def outstanding(status: Column) -> Column:
    """Billed and not paid; an invoice without a status counts as not paid."""
    return ~status.eqNullSafe(PAID)


def overdue(status: Column) -> Column:
    """Taken from the status, never from the due date: an open invoice past its due
    date is outstanding, not overdue."""
    return status == OVERDUE


def ar_class(status: Column) -> Column:
    return F.when(status == PAID, "paid").when(status == OVERDUE, "overdue").otherwise("outstanding")


def open_critical(status: Column, severity: Column) -> Column:
    return (status == "Open") & (severity == "Critical")


def renews_soon(renewal_date: Column, terms: Terms) -> Column:
    """Renewal from the as-of date to ``renewal_days`` after it, both included."""
    start = F.lit(terms.as_of)
    return renewal_date.between(start, F.date_add(start, terms.renewal_days))
