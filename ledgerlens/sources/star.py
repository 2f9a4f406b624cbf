"""Finance tables derived from a sales star schema and an event stream.

Orders become invoices, line items cloud costs, events usage and support cases. The
business clock ends on ``AS_OF``; billing covers the six months before it. Telemetry
runs on its own clock, in six five-day periods.
"""

from __future__ import annotations

import datetime as dt
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import cents, divide, exact_sum, exact_unit_sum, number, total
from ledgerlens.functions.identifiers import cyclic, period_key
from ledgerlens.operators.billing import payments_from_invoices
from ledgerlens.operators.usage import usage_metering
from ledgerlens.schema import TABLES, Terms, columns

AS_OF = dt.date(2001, 7, 31)
TERMS = Terms(as_of=AS_OF)
WINDOW_START, WINDOW_END = "2001-02-01", "2001-08-01"
YEAR_START = "2000-08-01"
EPOCH, PERIOD_DAYS, HOURS_PER_PERIOD = dt.date(2024, 1, 1), 5, 120
CASES_OPEN_SINCE = "2024-01-24"

METHODS = ("transfer", "card", "cheque", "debit")

CATEGORY_TEXTS = {
    "Expansion": ("Renewal is very likely", "Prepare an expansion proposal"),
    "Likely": ("Renewal is likely", "Confirm renewal terms"),
    "Watch": ("Renewal needs attention", "Schedule an adoption review"),
    "At Risk": ("Renewal is unlikely", "Run an executive value review"),
}


def _instant(text: str) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    return F.lit(text).cast("timestamp_ntz")


def _hundredths(name: str) -> Column:
    return F.rint(F.col(name) * 100).cast("bigint")


def days_early(order: Column) -> Column:
    """How many days before its due date an invoice is settled, by the key of its order."""
    return (order % 10).cast("int")


def _key(name: str) -> Column:
    return F.col(name).cast("string")


def remembered(build):
    """A method whose results its object keeps, for as long as the object lives."""

    @wraps(build)
    def kept(self, *args):
        found = self.__dict__.setdefault("_remembered", {})
        if (key := (build.__name__, *args)) not in found:
            found[key] = build(self, *args)
        return found[key]

    return kept


class StarSource:
    """The finance tables of one star-schema directory, each a lazy DataFrame.

    It keeps plans, not data: a table asked for again is the same DataFrame.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @remembered
    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def tables(self, *names: str) -> dict[str, DataFrame]:
        """The named tables, or all that are not computed from others. ``subscriptions:lean``
        stands for subscriptions without their product, which costs a pass over line items,
        ``customers:lean`` for customers without country and segment."""
        chosen = names or tuple(t for t in TABLES if t != "customer_finance_summary")
        found = {}
        for name in chosen:
            table, _, variant = name.partition(":")
            found[table] = getattr(self, f"{variant}_{table}" if variant else table)()
        return found

    # --- orders ---------------------------------------------------------------

    @remembered
    def _orders_before_end(self) -> DataFrame:
        return self.read("orders").filter(F.col("o_orderdate") < _instant(WINDOW_END))

    @remembered
    def _orders_in_window(self) -> DataFrame:
        return self._orders_before_end().filter(F.col("o_orderdate") >= _instant(WINDOW_START))

    @remembered
    def _subscription_keys(self) -> DataFrame:
        keys = self._orders_before_end().select("o_custkey").distinct()
        return keys.select(_key("o_custkey").alias("subscription_id"))

    # --- dimensions -----------------------------------------------------------

    @remembered
    def customers(self) -> DataFrame:
        nation = self.read("nation").join(
            self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return (
            self.read("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                _key("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                F.col("c_mktsegment").alias("industry"),
                F.col("n_name").alias("country"),
                F.col("r_name").alias("segment"),
                F.concat(F.lit("owner-"), F.col("c_custkey") % 20).alias("account_owner"),
            )
        )

    @remembered
    def lean_customers(self) -> DataFrame:
        return self.read("customer").select(
            _key("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
        )

    @remembered
    def products(self) -> DataFrame:
        return self.read("part").select(
            _key("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_family"),
            cents(F.col("p_retailprice") * 12).alias("list_price_arr"),
        )

    @remembered
    def _subscription_terms(self) -> DataFrame:
        """One row per ordering customer: dates, annual revenue, tier, status."""
        in_year = F.col("o_orderdate") >= _instant(YEAR_START)
        orders = self._orders_before_end().groupBy("o_custkey").agg(
            F.min("o_orderdate").cast("date").alias("start_date"),
            F.max("o_orderdate").alias("last_order"),
            total(F.when(in_year, F.col("o_totalprice"))).alias("arr"),
        )
        return orders.join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            "o_custkey",
            "c_acctbal",
            _key("o_custkey").alias("subscription_id"),
            _key("o_custkey").alias("customer_id"),
            number(F.col("arr")).alias("arr"),
            "start_date",
            F.date_add(F.lit(AS_OF), (F.col("o_custkey") * 17 % 365 + 1).cast("int")).alias("renewal_date"),
            F.lit(HOURS_PER_PERIOD).cast("bigint").alias("licensed_users"),
            F.col("c_mktsegment").alias("contract_tier"),
            F.when(F.col("last_order") >= _instant(YEAR_START), "Active").otherwise("Lapsed").alias("status"),
        )

    @remembered
    def _main_product(self) -> DataFrame:
        """The part each customer spent most on, ties by the smaller key.

        A line item looks its order up row by row, so adaptive execution can split a hot order; the choice per
        customer is an aggregate over (spend, key).
        """
        lines = self.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_extendedprice")
        orders = self._orders_before_end().select("o_orderkey", "o_custkey")
        spend = (
            lines.join(orders, "o_orderkey")
            .groupBy("o_custkey", "l_partkey")
            .agg(exact_sum("l_extendedprice").alias("spend"))
        )
        best = F.max(F.struct("spend", (-F.col("l_partkey")).alias("tie"), "l_partkey")).alias("best")
        return spend.groupBy("o_custkey").agg(best).select(
            F.col("o_custkey").alias("p_custkey"), F.col("best.l_partkey").cast("string").alias("product_id")
        )

    @remembered
    def subscriptions(self) -> DataFrame:
        product = self._main_product()
        found = self._subscription_terms().join(product, F.col("o_custkey") == F.col("p_custkey"), "left")
        return found.select(*columns("subscriptions"))

    @remembered
    def lean_subscriptions(self) -> DataFrame:
        return self._subscription_terms().select(*[c for c in columns("subscriptions") if c != "product_id"])

    @remembered
    def renewal_forecasts(self) -> DataFrame:
        probability = F.floor((F.col("c_acctbal") + 1000) / 11000 * 100).cast("double") / 100
        category = (
            F.when(F.col("renewal_probability") >= 0.90, "Expansion")
            .when(F.col("renewal_probability") >= 0.70, "Likely")
            .when(F.col("renewal_probability") >= 0.55, "Watch")
            .otherwise("At Risk")
        )

        def text(position: int) -> Column:
            column = F.lit(None).cast("string")
            for name, texts in CATEGORY_TEXTS.items():
                column = F.when(F.col("forecast_category") == name, texts[position]).otherwise(column)
            return column

        return (
            self._subscription_terms()
            .withColumn("renewal_probability", probability)
            .withColumn("forecast_category", category)
            .select(
                F.concat(F.lit("RF-"), "subscription_id").alias("forecast_id"),
                "subscription_id",
                "customer_id",
                "renewal_date",
                F.col("arr").alias("renewal_arr"),
                "renewal_probability",
                "forecast_category",
                text(0).alias("risk_reason"),
                text(1).alias("recommended_action"),
            )
        )

    # --- facts ----------------------------------------------------------------

    @remembered
    def invoices(self) -> DataFrame:
        due = F.date_add(F.col("o_orderdate").cast("date"), TERMS.due_days)
        status = F.when(F.col("o_orderstatus") == "F", "Paid").when(F.col("o_orderstatus") == "P", "Overdue")
        return self._orders_in_window().select(
            _key("o_orderkey").alias("invoice_id"),
            _key("o_custkey").alias("customer_id"),
            _key("o_custkey").alias("subscription_id"),
            F.col("o_orderdate").cast("date").alias("invoice_date"),
            due.alias("due_date"),
            cents("o_totalprice").alias("amount"),
            status.otherwise("Open").alias("status"),
            F.when(F.col("o_orderstatus") == "F", F.date_sub(due, days_early(F.col("o_orderkey")))).alias("paid_date"),
        )

    @remembered
    def payments(self) -> DataFrame:
        return payments_from_invoices(self.invoices(), F.col("customer_id").cast("bigint"), METHODS)

    def event_period(self) -> Column:
        """First day of the period of an event."""
        day = F.datediff(F.col("ts").cast("date"), F.lit(EPOCH))
        return F.date_add(F.lit(EPOCH), (F.floor(day / PERIOD_DAYS) * PERIOD_DAYS).cast("int"))

    @remembered
    def metered(self) -> DataFrame:
        """Telemetry of every user per five-day period, known as a subscription or not. The
        active units are the hours of the period with an event."""
        day = F.datediff(F.col("ts").cast("date"), F.lit(EPOCH))
        hour = F.pmod(day, F.lit(PERIOD_DAYS)) * 24 + F.hour("ts")
        return usage_metering(
            self.read("events"), F.col("user_id"), self.event_period(), hour, F.col("value"), HOURS_PER_PERIOD
        ).withColumn("subscription_id", _key("subscription_id"))

    @remembered
    def usage_monthly(self) -> DataFrame:
        """Metered usage of known subscriptions; events are added up before the lookup."""
        licensed = F.lit(HOURS_PER_PERIOD).cast("bigint")
        known = self.metered().join(self._subscription_keys(), "subscription_id", "left_semi")
        return known.select(
            period_key(F.col("subscription_id"), F.col("usage_month"), pattern="yyyyMMdd").alias("usage_id"),
            "subscription_id",
            F.col("subscription_id").alias("customer_id"),
            "usage_month",
            licensed.alias("licensed_users"),
            "active_users",
            divide(F.col("active_users").cast("double"), licensed.cast("double")).alias("adoption_rate"),
            "compute_hours",
            "production_jobs",
        )

    @remembered
    def support_cases(self) -> DataFrame:
        errors = (
            self.read("events")
            .filter(F.col("event_type") == "error")
            .select("event_id", "ts", "value", "event_type", _key("user_id").alias("subscription_id"))
        )
        severity = (
            F.when(F.col("value") >= 100, "Critical").when(F.col("value") >= 50, "High").when(F.col("value") >= 20, "Medium")
        )
        resolved = F.col("ts") < _instant(CASES_OPEN_SINCE)
        days = (F.col("event_id") % 5 + 1).cast("int")
        return errors.join(self._subscription_keys(), "subscription_id", "left_semi").select(
            _key("event_id").alias("case_id"),
            F.col("subscription_id").alias("customer_id"),
            "subscription_id",
            severity.otherwise("Low").alias("severity"),
            F.when(resolved, "Resolved").otherwise("Open").alias("status"),
            F.col("event_type").alias("case_title"),
            F.col("ts").cast("date").alias("opened_date"),
            F.when(resolved, F.date_add(F.col("ts").cast("date"), days)).alias("resolved_date"),
            (F.floor((_hundredths("value") + 5) / 10) / 100).alias("support_hours"),
        )

    @remembered
    def cloud_costs(self) -> DataFrame:
        """Line items priced per customer and month. A price in cents times a rate in
        hundredths is a whole number of units.

        Only line items of the window's orders are added up: the orders' keys are joined to
        the lines first, by broadcast where they are small enough for it, else with a runtime
        filter of their keys or as a join whose hot orders can be split.
        """
        price = _hundredths("l_extendedprice")
        wanted = self._orders_in_window().select(F.col("o_orderkey").alias("l_orderkey"))
        per_order = self.read("lineitem").join(wanted, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(
            exact_unit_sum(price * _hundredths("l_discount")).alias("compute"),
            exact_unit_sum(price * _hundredths("l_tax")).alias("storage"),
            exact_unit_sum(_hundredths("l_quantity") * 100_000).alias("support"),
        )
        orders = self._orders_in_window().select(
            "o_orderkey", "o_custkey", F.trunc("o_orderdate", "month").alias("cost_month")
        )
        sums = (
            orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy("o_custkey", "cost_month")
            .agg(*[F.sum(c).alias(c) for c in ("compute", "storage", "support")])
            .withColumn("customer_id", _key("o_custkey"))
        )
        return sums.select(
            period_key(F.col("customer_id"), F.col("cost_month"), prefix="COST").alias("cost_id"),
            F.col("customer_id").alias("subscription_id"),
            "customer_id",
            "cost_month",
            number(F.col("compute")).alias("compute_cost"),
            number(F.col("storage")).alias("storage_cost"),
            number(F.col("support")).alias("support_cost"),
            number(F.col("compute") + F.col("storage") + F.col("support")).alias("total_cost"),
        )
