"""Cost allocation from a rate card, and cost change over time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import change_pct, divide, exact, exact_sum, number


@dataclass(frozen=True)
class RateCard:
    """Prices per unit; the support load multiplies the support base by class."""

    compute_rate: str
    storage_base: str
    storage_step: str
    support_base: str
    support_step: str
    support_load: dict[str, float] = field(default_factory=dict)
    default_load: float = 1.0


def with_support_load(subscriptions: DataFrame, card: RateCard, tier: str = "contract_tier") -> DataFrame:
    """The support load of each subscription's class, 1.0 for classes not on the card.

    The card has one row per class, whatever the size of the tables.
    """
    rows = list(card.support_load.items())
    loads = subscriptions.sparkSession.createDataFrame(rows, f"{tier} string, card_load double")
    return (
        subscriptions.join(F.broadcast(loads), tier, "left")
        .withColumn("support_load", F.coalesce("card_load", F.lit(card.default_load)))
        .drop("card_load")
    )


def cost_allocation(usage: DataFrame, loads: DataFrame, card: RateCard, period_index: Column) -> DataFrame:
    """Compute, storage and support cost per subscription and period, and their total.

    ``loads`` has one row per subscription with its ``support_load``; ``period_index``
    counts periods from 0.
    """
    index = period_index.cast("int")

    def price(text: str) -> Column:
        return F.lit(text).cast("decimal(12,2)")

    compute = F.round(exact("compute_hours") * price(card.compute_rate), 2)
    storage = price(card.storage_base) + price(card.storage_step) * index
    load = F.col("support_load").cast("decimal(6,2)")
    support = F.round(price(card.support_base) * load + price(card.support_step) * index, 2)
    return (
        usage.join(loads.select("subscription_id", "support_load"), "subscription_id", "left")
        .select(
            "subscription_id",
            "customer_id",
            "usage_month",
            compute.alias("compute"),
            storage.alias("storage"),
            support.alias("support"),
        )
        .select(
            "subscription_id",
            "customer_id",
            F.col("usage_month").alias("cost_month"),
            number(F.col("compute")).alias("compute_cost"),
            number(F.col("storage")).alias("storage_cost"),
            number(F.col("support")).alias("support_cost"),
            number(F.col("compute") + F.col("storage") + F.col("support")).alias("total_cost"),
        )
    )


def paired_periods(costs: DataFrame, usage: DataFrame, calendars_differ: bool = False) -> DataFrame:
    """Cost and hours per subscription and period.

    Both sides are added up to (subscription, month) first. If the two tables keep
    separate calendars, the n-th month of one is paired with the n-th of the other;
    periods without a partner drop out either way.
    """
    cost = costs.groupBy("subscription_id", F.col("cost_month").alias("month")).agg(
        exact_sum("total_cost").alias("cost")
    )
    hours = usage.groupBy("subscription_id", F.col("usage_month").alias("month")).agg(
        exact_sum("compute_hours").alias("hours")
    )
    by_month = Window.partitionBy("subscription_id").orderBy("month")
    if calendars_differ:
        place = F.row_number().over(by_month).cast("bigint")
        cost = cost.withColumn("period", place).drop("month")
        hours = hours.withColumn("period", place).drop("month")
    else:
        cost = cost.withColumnRenamed("month", "period")
        hours = hours.withColumnRenamed("month", "period")
    return cost.join(hours, ["subscription_id", "period"]).select(
        "subscription_id",
        "period",
        number(F.col("cost")).alias("total_cost"),
        number(F.col("hours")).alias("compute_hours"),
        divide(number(F.col("cost")), number(F.col("hours"))).alias("unit_cost"),
    )


def cost_change(paired: DataFrame) -> DataFrame:
    """Total and unit cost of each period beside the period before."""
    by_period = Window.partitionBy("subscription_id").orderBy("period")
    return paired.select(
        "subscription_id",
        "period",
        "total_cost",
        "unit_cost",
        (F.col("total_cost") - F.lag("total_cost").over(by_period)).alias("total_cost_change"),
        (F.col("unit_cost") - F.lag("unit_cost").over(by_period)).alias("unit_cost_change"),
    )


def cost_trend(paired: DataFrame) -> DataFrame:
    """First and last total and unit cost per subscription, and the change in percent."""
    ends = paired.groupBy("subscription_id").agg(
        F.min_by("total_cost", "period").alias("first_total_cost"),
        F.max_by("total_cost", "period").alias("last_total_cost"),
        F.min_by("unit_cost", "period").alias("first_unit_cost"),
        F.max_by("unit_cost", "period").alias("last_unit_cost"),
        F.count(F.lit(1)).alias("periods"),
    )
    return ends.withColumn(
        "total_cost_change_pct", change_pct(F.col("first_total_cost"), F.col("last_total_cost"))
    ).withColumn("unit_cost_change_pct", change_pct(F.col("first_unit_cost"), F.col("last_unit_cost")))
