"""The reconciled customer finance summary and the portfolio totals over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.amounts import change_pct, exact_sum, margin_pct, monthly, number, total
from ledgerlens.operators.customer import next_forecast
from ledgerlens.operators.quality import assert_quality, quality_report
from ledgerlens.operators.usage import adoption_by_customer
from ledgerlens.schema import Terms, columns
from ledgerlens.sources.snapshots import Load, begin
from ledgerlens.sources.tables import audit_of, read_from, write_to

# Where the measures behind each summary column come from.
_SOURCES = {
    "arr": ("subscriptions",),
    "mrr": ("subscriptions",),
    "billed_revenue_6m": ("invoices",),
    "cash_collected_6m": ("payments",),
    "ar_outstanding": ("invoices",),
    "overdue_ar": ("invoices",),
    "cost_6m": ("cloud_costs",),
    "gross_margin_pct": ("invoices", "cloud_costs"),
    "latest_adoption_rate": ("usage_monthly",),
    "usage_trend_pct": ("usage_monthly",),
    "open_critical_cases": ("support_cases",),
    "renewal_date": ("renewal_forecasts",),
    "renewal_probability": ("renewal_forecasts",),
    "renewal_category": ("renewal_forecasts",),
    "risk_reason": ("renewal_forecasts",),
    "recommended_action": ("renewal_forecasts",),
}
_FORECASTS = "renewal_forecasts"


def _measure_rows(dfs: dict[str, DataFrame], table: str) -> DataFrame:
    """The rows of one fact table as (customer_id, measures)."""
    amount, status, df = F.col("amount"), F.col("status"), dfs[table]
    if table == "subscriptions":
        return df.filter(status == "Active").select("customer_id", F.col("arr").alias("arr"))
    if table == "invoices":
        return df.select(
            "customer_id",
            amount.alias("billed"),
            F.when(rules.outstanding(status), amount).alias("outstanding"),
            F.when(rules.overdue(status), amount).alias("overdue"),
        )
    if table == "payments":
        return df.select("customer_id", amount.alias("collected"))
    if table == "cloud_costs":
        return df.select("customer_id", F.col("total_cost").alias("cost"))
    if table == "support_cases":
        critical = rules.open_critical(status, F.col("severity"))
        return df.filter(critical).select("customer_id", F.lit(1).cast("bigint").alias("critical"))
    return adoption_by_customer(df)


def customer_measures(dfs: dict[str, DataFrame], tables: list[str]) -> DataFrame:
    """One row per customer with the sums and counts over the named fact tables.

    The tables are stacked with one column per measure and grouped once: a single
    shuffle of map-side combined rows in place of one aggregate and one join per table,
    and since nothing is joined, nothing can fan out.
    """
    return _added_up(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_measure_rows(dfs, t) for t in tables])
    )


def _added_up(rows: DataFrame) -> DataFrame:
    measures = []
    for c in rows.columns:
        if c == "critical":
            measures.append(F.coalesce(F.sum(c), F.lit(0)).alias(c))
        elif c.endswith("_adoption_rate"):
            measures.append(F.max(c).alias(c))
        elif c != "customer_id":
            measures.append(total(F.col(c)).alias(c))
    return rows.groupBy("customer_id").agg(*measures)


def measures_of(dfs: dict[str, DataFrame], table: str) -> DataFrame:
    """One row per customer with the sums and counts over one fact table. Where tables are stored by
    customer, each is added up, and the sums are joined, where they lie."""
    return _added_up(_measure_rows(dfs, table))


def customer_summary(
    dfs: dict[str, DataFrame], wanted: Sequence[str] | None = None, carried: bool = False, by_customer: bool = False
) -> DataFrame:
    """One row per customer, nineteen columns or those ``wanted``.

    Amounts come out as doubles, or, ``carried``, as the exact decimals they are: for
    whatever adds them up again. ``by_customer`` says that the tables are stored that way
    (``store_by_customer``); the result is the same.

    Only the fact tables behind the wanted columns are read. ARR adds up active
    subscriptions. The forecast is the one that renews first. A customer without facts
    keeps its row: sums and counts 0, margin, trend and forecast columns null.
    """
    chosen = [c for c in columns("customer_finance_summary") if wanted is None or c in wanted]
    needed = {t for c in chosen for t in _SOURCES.get(c, ())}
    facts = [t for t in dict.fromkeys(t for s in _SOURCES.values() for t in s) if t in needed and t != _FORECASTS]

    joined = dfs["customers"].select("customer_id", "customer_name")
    if facts:
        measures = [measures_of(dfs, t) for t in facts] if by_customer else [customer_measures(dfs, facts)]
        joined = reduce(lambda a, b: a.join(b, "customer_id", "left"), [joined, *measures])
    if _FORECASTS in needed:
        forecast = next_forecast(dfs[_FORECASTS]).drop("subscription_id", "renewal_arr")
        joined = joined.join(forecast, "customer_id", "left")

    def amount(measure: str) -> Column:
        return F.coalesce(measure, F.lit(0).cast("decimal(30,2)"))

    def shown(value: Column) -> Column:
        return value if carried else number(value)

    def trend() -> Column:
        return change_pct(F.col("first_adoption_rate"), F.col("latest_adoption_rate"))

    formulas = {
        "profile_id": lambda: F.concat(F.lit("FP-"), "customer_id"),
        "arr": lambda: shown(amount("arr")),
        "mrr": lambda: shown(monthly(amount("arr"))),
        "billed_revenue_6m": lambda: shown(amount("billed")),
        "cash_collected_6m": lambda: shown(amount("collected")),
        "ar_outstanding": lambda: shown(amount("outstanding")),
        "overdue_ar": lambda: shown(amount("overdue")),
        "cost_6m": lambda: shown(amount("cost")),
        "gross_margin_pct": lambda: F.round(margin_pct(amount("billed"), amount("cost")), 2),
        "usage_trend_pct": lambda: F.round(trend(), 2),
        "open_critical_cases": lambda: F.coalesce("critical", F.lit(0)).cast("bigint"),
        "renewal_category": lambda: F.col("forecast_category"),
    }
    return joined.select(*[formulas.get(c, lambda c=c: F.col(c))().alias(c) for c in chosen])


def with_summary(dfs: dict[str, DataFrame], wanted: Sequence[str] | None = None, carried: bool = False) -> dict[str, DataFrame]:
    """The table set completed by its summary."""
    return {**dfs, "customer_finance_summary": customer_summary(dfs, wanted, carried)}


def _written(dfs: dict[str, DataFrame], load: Load, partition_by: Mapping[str, str] | None) -> list[tuple[str, int]]:
    """Write the base tables, then the summary worked out from the stored ones: the facts
    are derived once, and the summary reads columnar files."""
    rows = write_to(load, dfs, partition_by=partition_by)
    return rows + write_to(load, {"customer_finance_summary": customer_summary(read_from(load, dfs))})


def load_with_summary(
    dfs: dict[str, DataFrame], root: str, partition_by: Mapping[str, str] | None = None
) -> DataFrame:
    """Replace the tables below ``root`` as one, the summary with them; the audit of all."""
    load = begin(next(iter(dfs.values())).sparkSession, root)
    rows = _written(dfs, load, partition_by)
    load.publish()
    return audit_of(load.spark, rows)


def load_checked(
    dfs: dict[str, DataFrame],
    root: str,
    terms: Terms,
    partition_by: Mapping[str, str] | None = None,
    known: Mapping[str, float] | None = None,
) -> DataFrame:
    """Like ``load_with_summary``, but all checks of the quality report must hold first: they run
    on the tables as written, before these are published. ``QualityError`` leaves those
    below ``root`` as they were. ``known`` are failures that the load may have, such as the
    ``failed_checks`` of the load before."""
    load = begin(next(iter(dfs.values())).sparkSession, root)
    rows = _written(dfs, load, partition_by)
    assert_quality(quality_report(read_from(load, (*dfs, "customer_finance_summary")), terms), known)
    load.publish()
    return audit_of(load.spark, rows)


PORTFOLIO = ("billed_revenue_6m", "cash_collected_6m", "ar_outstanding", "at_risk_arr")


def portfolio_amounts(summary: DataFrame, terms: Terms) -> DataFrame:
    """The four totals as decimals, exact if the summary is a carried one."""
    at_risk = F.when(rules.at_risk(F.col("renewal_probability"), terms), F.col("arr"))
    return summary.agg(*[total(at_risk if c == "at_risk_arr" else c).alias(c) for c in PORTFOLIO])


def portfolio_totals(summary: DataFrame, terms: Terms) -> DataFrame:
    return portfolio_amounts(summary, terms).select(*[number(F.col(c)).alias(c) for c in PORTFOLIO])


def active_arr(subscriptions: DataFrame) -> DataFrame:
    """Recurring revenue of active subscriptions."""
    return subscriptions.filter(F.col("status") == "Active").agg(
        number(total("arr")).alias("active_arr"), F.count(F.lit(1)).alias("subscriptions")
    )


def portfolio_counts(subscriptions: DataFrame) -> DataFrame:
    """Active customers, active subscriptions and their ARR.

    Customers are counted after grouping by customer, so no task keeps a set of them.
    """
    per_customer = (
        subscriptions.filter(F.col("status") == "Active")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("n"), exact_sum("arr").alias("arr"))
    )
    return per_customer.agg(
        F.count("customer_id").alias("active_customers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("active_subscriptions"),
        number(F.coalesce(F.round(F.sum("arr"), 2), F.lit(0))).alias("total_arr"),
    )
