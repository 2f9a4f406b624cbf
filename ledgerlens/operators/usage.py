"""Usage metering, adoption and its change over time.

Windows here run over one row per subscription and period; the number of periods
bounds a window, however many events a subscription sends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import change_pct, divide, exact_sum, number


def _by_month() -> WindowSpec:
    return Window.partitionBy("subscription_id", "customer_id").orderBy("usage_month")


_WORD = 63


def distinct_below(index: Column, bound: int) -> Column:
    """Distinct values of a whole number from 0 to ``bound`` - 1, counted as bits of a few
    longs. These combine before the shuffle, so the groups themselves are all that is
    shuffled, where a distinct count shuffles every (group, value) pair. A value outside of
    the range is an error; nulls do not count."""
    index = F.when(index.isNull() | index.between(0, bound - 1), index).otherwise(
        F.raise_error(F.lit(f"a unit is not from 0 to {bound - 1}")).cast("bigint")
    )
    one, words = F.lit(1).cast("bigint"), []
    for start in range(0, bound, _WORD):
        bit = F.call_function("shiftleft", one, (index - start).cast("int"))
        word = F.bit_or(F.when((index >= start) & (index < start + _WORD), bit))
        words.append(F.bit_count(F.coalesce(word, F.lit(0).cast("bigint"))))
    return reduce(lambda a, b: a + b, words).cast("bigint")


def usage_metering(
    events: DataFrame,
    subscription: Column,
    period: Column,
    unit: Column,
    hours: Column,
    unit_bound: int | None = None,
) -> DataFrame:
    """Telemetry to one row per subscription and period: distinct active units, hours, jobs.

    Any unit will do: its distinct count is planned in two steps, by (subscription,
    period, unit) and then by (subscription, period), so a hot subscription is spread over
    its units. Where units are numbers below a small ``unit_bound`` one step is enough.
    """
    active = F.count_distinct(unit) if unit_bound is None else distinct_below(unit, unit_bound)
    return events.groupBy(subscription.alias("subscription_id"), period.alias("usage_month")).agg(
        active.alias("active_users"),
        number(exact_sum(hours)).alias("compute_hours"),
        F.count(F.lit(1)).alias("production_jobs"),
    )


def with_adoption_rate(usage: DataFrame) -> DataFrame:
    rate = divide(F.col("active_users").cast("double"), F.col("licensed_users").cast("double"))
    return usage.withColumn("adoption_rate", rate)


def first_last_adoption(usage: DataFrame) -> DataFrame:
    """First and last adoption per customer and subscription, by month; no sort."""
    return usage.groupBy("customer_id", "subscription_id").agg(
        F.min("usage_month").alias("first_month"),
        F.min_by("adoption_rate", "usage_month").alias("first_adoption"),
        F.max("usage_month").alias("last_month"),
        F.max_by("adoption_rate", "usage_month").alias("last_adoption"),
    )


def adoption_by_customer(usage: DataFrame) -> DataFrame:
    """The earliest and the latest adoption of each customer; several subscriptions
    in the same month go by subscription id."""
    first = F.min_by("first_adoption", F.struct("first_month", "subscription_id"))
    last = F.max_by("last_adoption", F.struct("last_month", "subscription_id"))
    return (
        first_last_adoption(usage)
        .groupBy("customer_id")
        .agg(first.alias("first_adoption_rate"), last.alias("latest_adoption_rate"))
    )


def usage_trend(usage: DataFrame) -> DataFrame:
    """Change in percent from the first to the last adoption of each customer."""
    trend = change_pct(F.col("first_adoption_rate"), F.col("latest_adoption_rate"))
    return adoption_by_customer(usage).withColumn("usage_trend_pct", trend)


def month_index(month: Column) -> Column:
    """Months as consecutive whole numbers."""
    return F.year(month) * 12 + F.month(month)


Index = Callable[[Column], Column]


def _monthly(usage: DataFrame, index: Index) -> DataFrame:
    """One row per subscription and month (the highest rate, should a month be there twice),
    so that a window holds no more rows than there are months, with the month's number."""
    monthly = usage.groupBy("subscription_id", "customer_id", "usage_month").agg(F.max("adoption_rate").alias("adoption_rate"))
    return monthly.withColumn("_at", index(F.col("usage_month")).cast("long"))


def _changes(usage: DataFrame, index: Index) -> DataFrame:
    follows = F.lag("_at").over(_by_month()) == F.col("_at") - 1
    previous = F.when(follows, F.lag("adoption_rate").over(_by_month()))
    return (
        _monthly(usage, index)
        .withColumn("previous_rate", previous)
        .withColumn("rate_change", F.col("adoption_rate") - F.col("previous_rate"))
    )


def usage_change(usage: DataFrame, index: Index = month_index) -> DataFrame:
    """Adoption of each month beside the month before, null where that month is missing.

    ``index`` numbers the months, so that neighbours differ by one; other calendars, such
    as periods of days, bring their own.
    """
    return _changes(usage, index).drop("_at")


def decline_streak(usage: DataFrame, index: Index = month_index) -> DataFrame:
    """The longest run of consecutive declines per subscription, 0 if none.

    Declines in neighbouring months share their month's number less their position among
    all declines; a month without a decline, or a missing one, moves on the first alone.
    """
    falls = F.col("adoption_rate") < F.col("previous_rate")
    marked = _changes(usage, index).withColumn("fall", F.coalesce(falls, F.lit(False)).cast("int"))
    island = F.when(F.col("fall") == 1, F.col("_at") - F.sum("fall").over(_by_month()))
    return (
        marked.withColumn("island", island)
        .groupBy("subscription_id", "customer_id", "island")
        .agg(F.sum("fall").alias("length"))
        .groupBy("subscription_id", "customer_id")
        .agg(F.max("length").alias("decline_streak"))
    )


def usage_islands(usage: DataFrame, index: Index = month_index) -> DataFrame:
    """Unbroken stretches of months with usage per subscription, and how many months are missing
    before each (null for the first)."""
    island = F.col("_at") - F.row_number().over(_by_month())
    stretches = (
        _monthly(usage, index)
        .withColumn("island", island)
        .groupBy("subscription_id", "customer_id", "island")
        .agg(
            F.min("usage_month").alias("first_month"), F.max("usage_month").alias("last_month"),
            F.count(F.lit(1)).alias("months"), F.min("_at").alias("_from"), F.max("_at").alias("_to"),
        )
    )
    before = F.lag("_to").over(Window.partitionBy("subscription_id", "customer_id").orderBy("_from"))
    return stretches.withColumn("missing_before", F.col("_from") - before - 1).drop("island", "_from", "_to")


# --- distinct ids ------------------------------------------------------------


def id_bitmaps(events: DataFrame, groups: Sequence[str], key: Column) -> DataFrame:
    """Per group and range of 32,768 whole numbers, the ids that occur, as a bitmap.

    Bitmaps are built before the shuffle and can be stored and merged, for ids of any size;
    a hot group is spread over its ranges. Null ids do not count.
    """
    return events.groupBy(*groups, F.bitmap_bucket_number(key).alias("id_range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("ids")
    )


def count_ids(bitmaps: DataFrame, groups: Sequence[str], name: str = "distinct_ids") -> DataFrame:
    """Distinct ids per group, from bitmaps of these or of finer groups."""
    merged = bitmaps.groupBy(*groups, "id_range").agg(F.bitmap_or_agg("ids").alias("ids"))
    return merged.groupBy(*groups).agg(F.coalesce(F.sum(F.bitmap_count("ids")), F.lit(0)).cast("bigint").alias(name))
