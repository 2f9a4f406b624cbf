"""The recurring business questions, over the customer finance summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.amounts import divide, number, total
from ledgerlens.operators.costs import cost_trend
from ledgerlens.operators.customer import COST_PARTS, cost_by_customer
from ledgerlens.operators.facts import overdue_forecast
from ledgerlens.operators.ordering import extreme_rows
from ledgerlens.operators.usage import Index, decline_streak, month_index
from ledgerlens.schema import Terms


def _risk(terms: Terms) -> Column:
    return rules.at_risk(F.col("renewal_probability"), terms)


def _declining(terms: Terms) -> Column:
    return rules.declining(F.col("usage_trend_pct"), terms)


# --- filters and bands -------------------------------------------------------


def at_risk_renewals(forecasts: DataFrame, terms: Terms) -> DataFrame:
    return forecasts.filter(_risk(terms))


def watch_renewals(forecasts: DataFrame, terms: Terms) -> DataFrame:
    return forecasts.filter(rules.watch(F.col("renewal_probability"), terms))


def renewal_bands(forecasts: DataFrame, terms: Terms) -> DataFrame:
    """Renewals and their ARR per band; renewals without a probability are a band of their own."""
    band = rules.renewal_band(F.col("renewal_probability"), terms)
    return forecasts.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("renewals"), number(total("renewal_arr")).alias("renewal_arr")
    )


def declining_adoption(summary: DataFrame, terms: Terms) -> DataFrame:
    return summary.filter(_declining(terms)).select("customer_id", "latest_adoption_rate", "usage_trend_pct")


def overdue_invoices(invoices: DataFrame) -> DataFrame:
    return invoices.filter(rules.overdue(F.col("status")))


def renewals_due(forecasts: DataFrame, terms: Terms) -> DataFrame:
    return forecasts.filter(rules.renews_soon(F.col("renewal_date"), terms))


def negative_margin(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("gross_margin_pct") < 0).select(
        "customer_id", "billed_revenue_6m", "cost_6m", "gross_margin_pct"
    )


# --- questions ---------------------------------------------------------------


def at_risk(summary: DataFrame, terms: Terms) -> DataFrame:
    """Which customers are at risk of renewal, and why?"""
    return (
        summary.filter(_risk(terms))
        .orderBy("renewal_probability", "customer_id")
        .select(
            "customer_name", "arr", "renewal_date", "renewal_probability", "usage_trend_pct",
            "open_critical_cases", "overdue_ar", "risk_reason", "recommended_action",
        )
    )


def _declining_critical(summary: DataFrame, terms: Terms) -> DataFrame:
    return summary.filter(_declining(terms) & (F.col("open_critical_cases") > 0))


def declining_critical(summary: DataFrame, terms: Terms) -> DataFrame:
    """Which customers have declining usage and open critical support cases?"""
    return (
        _declining_critical(summary, terms)
        .orderBy(F.col("arr").desc(), "customer_id")
        .select(
            "customer_name", "arr", "latest_adoption_rate", "usage_trend_pct", "open_critical_cases",
            "renewal_probability", "recommended_action",
        )
    )


def urgent_renewals(summary: DataFrame, terms: Terms) -> DataFrame:
    """Declining usage, critical cases and a renewal within the window."""
    return (
        _declining_critical(summary, terms)
        .filter(rules.renews_soon(F.col("renewal_date"), terms))
        .orderBy("renewal_date", "customer_id")
        .select(
            "customer_id", "customer_name", "arr", "renewal_date", "usage_trend_pct", "open_critical_cases",
            "renewal_probability",
        )
    )


def profitability(summary: DataFrame) -> DataFrame:
    """Every customer by margin, lowest first, those without a margin last."""
    return summary.orderBy(F.col("gross_margin_pct").asc_nulls_last(), "customer_id").select(
        "customer_name", "billed_revenue_6m", "cost_6m", "gross_margin_pct", "arr"
    )


def overdue_with_forecast(dfs: dict[str, DataFrame]) -> DataFrame:
    """Overdue invoices with their renewal data, least likely renewal first."""
    return overdue_forecast(dfs).orderBy("renewal_probability", "invoice_id")


def overdue_at_risk(dfs: dict[str, DataFrame], terms: Terms) -> DataFrame:
    """Overdue invoices whose renewal is at risk.

    The forecasts are filtered before the join, so only risky subscriptions meet invoices.
    """
    risky = at_risk_renewals(dfs["renewal_forecasts"], terms)
    return overdue_with_forecast({**dfs, "renewal_forecasts": risky})


def margin_drivers(summary: DataFrame, costs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` lowest margins with billed revenue, cost and each component's share.

    Costs meet the summary at customer grain, both partitioned by customer; each task
    then keeps its ``k`` lowest.
    """
    billed = summary.filter(F.col("gross_margin_pct").isNotNull())
    parts = cost_by_customer(costs).drop("cost_6m")
    lowest = extreme_rows(billed.join(parts, "customer_id", "left"), "gross_margin_pct", "customer_id", k)
    shares = [divide(F.col(c), F.col("cost_6m")).alias(c.replace("_cost", "_share")) for c in COST_PARTS]
    return lowest.select(
        "customer_id", "customer_name", "billed_revenue_6m", "cost_6m", "gross_margin_pct", *shares
    )


def forecast_evidence(summary: DataFrame, terms: Terms) -> DataFrame:
    """Each forecast beside the signals observed for its customer."""
    flags = {
        "is_at_risk": _risk(terms),
        "is_declining": F.coalesce(_declining(terms), F.lit(False)),
        "has_critical_case": F.col("open_critical_cases") > 0,
        "has_overdue": F.col("overdue_ar") > 0,
    }
    drivers = sum((flags[f].cast("int") for f in ("is_declining", "has_critical_case", "has_overdue")), F.lit(0))
    return summary.select(
        "customer_id", "renewal_probability", "renewal_category", "risk_reason",
        *[c.alias(n) for n, c in flags.items()],
        drivers.alias("drivers"),
    )


def unexplained_risk(summary: DataFrame, terms: Terms) -> DataFrame:
    """At-risk customers for whom no driver was observed."""
    return (
        forecast_evidence(summary, terms)
        .filter(F.col("is_at_risk") & (F.col("drivers") == 0))
        .select("customer_id", "renewal_probability", "renewal_category")
    )


def next_actions(summary: DataFrame, terms: Terms) -> DataFrame:
    """The recorded action for each at-risk customer with its evidence; what is not
    known stays null."""
    return (
        summary.filter(_risk(terms))
        .orderBy("renewal_probability", "customer_id")
        .select(
            "customer_id", "customer_name", "arr", "renewal_probability", "usage_trend_pct",
            "open_critical_cases", "overdue_ar", "recommended_action",
        )
    )


def executive_briefing(summary: DataFrame, terms: Terms) -> DataFrame:
    """Per band: customers, ARR, receivables, overdue, open critical cases, margin.

    The margin is that of the whole band, its revenue less its cost.
    """
    billed, cost = total("billed_revenue_6m"), total("cost_6m")
    band = rules.renewal_band(F.col("renewal_probability"), terms)
    return (
        summary.groupBy(band.alias("band"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            number(total("arr")).alias("arr"),
            number(total("ar_outstanding")).alias("ar_outstanding"),
            number(total("overdue_ar")).alias("overdue_ar"),
            F.sum("open_critical_cases").alias("open_critical_cases"),
            number(billed).alias("billed"),
            number(cost).alias("cost"),
        )
        .withColumn("margin_pct", divide(F.col("billed") - F.col("cost"), F.col("billed")) * 100)
        .drop("billed", "cost")
    )


def expansion_candidates(summary: DataFrame) -> DataFrame:
    return (
        summary.filter(F.col("renewal_category") == "Expansion")
        .orderBy(F.col("renewal_probability").desc(), "customer_id")
        .select("customer_id", "customer_name", "arr", "renewal_probability", "recommended_action")
    )


def usage_down_cost_up(summary: DataFrame, subscriptions: DataFrame, paired: DataFrame, terms: Terms) -> DataFrame:
    """Declining customers with a subscription whose cost per compute hour rose."""
    rising = cost_trend(paired).filter("unit_cost_change_pct > 0")
    owners = subscriptions.select("subscription_id", "customer_id")
    per_customer = (
        rising.join(owners, "subscription_id")
        .groupBy("customer_id")
        .agg(F.max("unit_cost_change_pct").alias("unit_cost_change_pct"))
    )
    return declining_adoption(summary, terms).join(per_customer, "customer_id")


def long_decline_streaks(usage: DataFrame, at_least: int = 2, index: Index = month_index) -> DataFrame:
    """Subscriptions whose adoption fell in at least so many months in a row."""
    return decline_streak(usage, index).filter(F.col("decline_streak") >= at_least)


def rollup_by(summary: DataFrame, customers: DataFrame, dimension: str) -> DataFrame:
    """The portfolio by a customer dimension: industry, country or segment."""
    return (
        summary.join(customers.select("customer_id", dimension), "customer_id")
        .groupBy(dimension)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            number(total("arr")).alias("arr"),
            number(total("billed_revenue_6m")).alias("billed_revenue_6m"),
            number(total("cost_6m")).alias("cost_6m"),
            number(total("ar_outstanding")).alias("ar_outstanding"),
            F.sum("open_critical_cases").alias("open_critical_cases"),
        )
    )
