import datetime as dt
from bisect import bisect_left, bisect_right

import pytest
from conftest import TERMS, day, rows
from pyspark.sql import functions as F

from ledgerlens.functions.identifiers import cyclic, padded, period_key
from ledgerlens.operators import billing, costs, customer, facts, ordering, usage


# --- billing -----------------------------------------------------------------


def test_schedule_has_one_row_per_month(company):
    schedule = billing.billing_schedule(company["subscriptions"], dt.date(2026, 3, 1), dt.date(2026, 8, 1))
    assert schedule.count() == 36
    mine = schedule.filter("subscription_id = 'S1'")
    assert rows(mine, "invoice_date", "amount")[0] == (day("2026-03-01"), 100.0)


def test_due_and_paid_dates(make):
    invoices = make(
        "invoices",
        {"invoice_id": "A", "invoice_date": day("2026-03-01"), "status": "Paid"},
        {"invoice_id": "B", "invoice_date": day("2026-03-01"), "status": "Open"},
    )
    settled = billing.with_settlement(billing.with_due_date(invoices, 29), F.lit(8))
    assert rows(settled, "invoice_id", "due_date", "paid_date") == [
        ("A", day("2026-03-30"), day("2026-03-22")),
        ("B", day("2026-03-30"), None),
    ]


def test_payments_only_for_paid_invoices(company):
    made = billing.payments_from_invoices(company["invoices"], F.lit(4), ("ACH", "Wire", "Card"))
    assert rows(made, "payment_id", "payment_date", "payment_method") == [
        ("PAY-I1", day("2026-08-25"), "Wire"),
        ("PAY-I4", day("2026-08-20"), "Wire"),
    ]


def test_payment_mismatches_are_told_apart(make):
    invoices = make(
        "invoices",
        *[
            {"invoice_id": i, "amount": 5.0, "status": s}
            for i, s in [("ok", "Paid"), ("none", "Paid"), ("open", "Open"), ("early", "Open"), ("off", "Paid"), ("twice", "Paid"), ("null", None)]
        ],
    )
    payments = make(
        "payments",
        *[
            {"payment_id": str(n), "invoice_id": i, "amount": a}
            for n, (i, a) in enumerate([("ok", 5.0), ("early", 5.0), ("off", 4.99), ("twice", 2.5), ("twice", 2.5), ("ghost", 1.0)])
        ],
    )
    assert dict(rows(billing.match_payments(invoices, payments), "invoice_id", "match")) == {
        "ok": "matched",
        "none": "paid_without_payment",
        "open": "unpaid",
        "null": "unpaid",
        "early": "payment_of_unpaid_invoice",
        "off": "amount_differs",
        "twice": "several_payments",
        "ghost": "payment_without_invoice",
    }
    assert billing.invoice_payment_mismatch(invoices, payments).count() == 5


def test_scalar_columns(spark):
    one = spark.range(1).select(
        padded("INV", F.lit(7)).alias("a"),
        padded("INV", F.lit(123456)).alias("b"),
        period_key(F.lit("S001"), F.lit(day("2026-03-01"))).alias("c"),
        period_key(F.lit("S001"), F.lit(day("2026-03-01")), prefix="COST").alias("d"),
        cyclic(F.lit(-1), ["x", "y", "z"]).alias("e"),
    )
    assert tuple(one.first()) == ("INV0007", "INV123456", "S001-202603", "COST-S001-202603", "z")


# --- usage and cost ----------------------------------------------------------


def test_metering(spark):
    events = spark.createDataFrame(
        [("S1", 1, "u1", 0.1), ("S1", 1, "u1", 0.2), ("S1", 1, "u2", 0.3), ("S1", 2, "u1", 1.0)],
        "sub string, period int, user string, hours double",
    )
    metered = usage.usage_metering(events, F.col("sub"), F.col("period"), F.col("user"), F.col("hours"))
    assert rows(metered) == [("S1", 1, 2, 0.6, 3), ("S1", 2, 1, 1.0, 1)]


def test_metering_of_numbered_units_equals_the_distinct_count(spark):
    events = spark.range(0, 4000, 1, 5).select(
        (F.col("id") % 7).alias("sub"), (F.col("id") % 3).alias("period"), (F.col("id") * F.col("id") % 130).alias("unit")
    )
    hours = F.lit(1.0)
    columns = [F.col(c) for c in ("sub", "period", "unit")]
    plain = usage.usage_metering(events, *columns, hours)
    assert rows(usage.usage_metering(events, *columns, hours, unit_bound=130)) == rows(plain)


def test_adoption_without_licences_is_null(make):
    usage_rows = make("usage_monthly", {"active_users": 5, "licensed_users": 0}, {"active_users": 1, "licensed_users": 4})
    assert rows(usage.with_adoption_rate(usage_rows), "adoption_rate") == [(0.25,), (None,)]


def test_trend_of_two_subscriptions_goes_by_month_then_id(make):
    def use(sid, month, rate):
        return {"subscription_id": sid, "customer_id": "C", "usage_month": day(month), "adoption_rate": rate}

    both = make(
        "usage_monthly",
        use("B", "2026-01-01", 0.9), use("A", "2026-01-01", 0.5), use("A", "2026-02-01", 0.1), use("B", "2026-02-01", 0.6),
    )
    assert rows(usage.usage_trend(both), "first_adoption_rate", "latest_adoption_rate")[0] == (0.5, 0.6)


def test_streak_counts_consecutive_declines(make):
    def months(sid, *rates):
        return [
            {"subscription_id": sid, "customer_id": sid, "usage_month": dt.date(2026, i + 1, 1), "adoption_rate": r}
            for i, r in enumerate(rates)
        ]

    table = make(
        "usage_monthly",
        *months("falls", 0.9, 0.8, 0.7, 0.6),
        *months("broken", 0.9, 0.8, 0.8, 0.7, 0.6, 0.9),
        *months("rises", 0.1, 0.2),
        *months("gap", 0.9, None, 0.8),
    )
    assert dict(rows(usage.decline_streak(table), "subscription_id", "decline_streak")) == {
        "falls": 3, "broken": 2, "rises": 0, "gap": 0,
    }


def test_missing_months_break_neighbours_and_streaks(make):
    def month(n, rate, year=2026):
        return {"subscription_id": "S", "customer_id": "C", "usage_month": dt.date(year, n, 1), "adoption_rate": rate}

    table = make("usage_monthly", month(1, 0.9), month(2, 0.8), month(5, 0.7), month(6, 0.6), month(12, 0.5), month(1, 0.4, 2027))
    before = {str(r.usage_month): r.previous_rate for r in usage.usage_change(table).collect()}
    assert before == {"2026-01-01": None, "2026-02-01": 0.9, "2026-05-01": None, "2026-06-01": 0.7, "2026-12-01": None, "2027-01-01": 0.5}
    assert rows(usage.decline_streak(table), "decline_streak") == [(1,)]
    stretches = [(str(r.first_month)[:7], str(r.last_month)[:7], r.months, r.missing_before) for r in usage.usage_islands(table).orderBy("first_month").collect()]
    assert stretches == [("2026-01", "2026-02", 2, None), ("2026-05", "2026-06", 2, 2), ("2026-12", "2027-01", 2, 5)]
    in_order = lambda day: F.month(day)  # noqa: E731 - another calendar: years do not count
    assert rows(usage.decline_streak(table.filter("usage_month < '2027-01-01'"), in_order), "decline_streak") == [(1,)]


def test_bitmaps_count_ids_of_any_size(spark):
    ids = [0, 1, 1, 32767, 32768, 5_000_000_000, 5_000_000_001, -1, -40_000, None]
    frame = spark.createDataFrame([(g, i) for g in "ab" for i in ids[: 6 if g == "a" else None]] + [("c", None)], "g string, id long")
    bitmaps = usage.id_bitmaps(frame, ["g"], F.col("id"))
    want = frame.groupBy("g").agg(F.count_distinct("id"))
    assert rows(usage.count_ids(bitmaps, ["g"])) == rows(want)
    assert rows(usage.count_ids(bitmaps, [])) == [(frame.select("id").distinct().count() - 1,)]
    assert usage.count_ids(usage.id_bitmaps(frame.limit(0), ["g"], F.col("id")), ["g"]).count() == 0
    assert usage.id_bitmaps(frame, ["g"], F.col("id"))._jdf.queryExecution().executedPlan().toString().count("partial_bitmap_construct_agg") == 1


PRICES = ("5.40", "700.00", "38.00", "1000.00", "105.00")


def test_support_load_defaults_to_one(company):
    card = costs.RateCard(*PRICES, support_load={"Gold": 2.0})
    assert {r.support_load for r in costs.with_support_load(company["subscriptions"], card).collect()} == {2.0}
    other = costs.RateCard(*PRICES, support_load={"Iron": 2.0})
    assert {r.support_load for r in costs.with_support_load(company["subscriptions"], other).collect()} == {1.0}


def test_cost_allocation(make, spark):
    table = make(
        "usage_monthly",
        {"subscription_id": "S", "customer_id": "C", "usage_month": day("2026-04-01"), "compute_hours": 10.5},
    )
    loads = spark.createDataFrame([("S", 1.4)], "subscription_id string, support_load double")
    card = costs.RateCard(*PRICES)
    found = costs.cost_allocation(table, loads, card, F.lit(1)).first()
    assert (found.compute_cost, found.storage_cost, found.support_cost) == (56.7, 738.0, 1505.0)
    assert found.total_cost == 2299.7


def test_cost_trend_pairs_by_month(company):
    paired = costs.paired_periods(company["cloud_costs"], company["usage_monthly"])
    assert paired.count() == 3
    trend = {r.subscription_id: r for r in costs.cost_trend(paired).collect()}
    assert trend["S1"].unit_cost_change_pct == pytest.approx(50.5)
    assert trend["S5"].unit_cost_change_pct == 0
    change = costs.cost_change(paired).filter("subscription_id = 'S1'")
    assert [r.total_cost_change for r in change.orderBy("period").collect()] == [None, pytest.approx(15.15)]


# --- customer lookups --------------------------------------------------------


def test_forecast_lookup_keeps_customers_without_one(company):
    found = customer.forecast_lookup(company["customers"], company["renewal_forecasts"])
    assert rows(found.filter("NOT has_forecast"), "customer_id") == [("C3",)]


def test_zero_fill(company):
    found = customer.customer_ar_zero_fill(company["customers"], company["invoices"])
    assert rows(found, "customer_id", "ar_outstanding")[2] == ("C3", 0.0)


def test_current_subscription(company):
    found = customer.current_subscription(company["subscriptions"])
    assert dict(rows(found, "customer_id", "subscription_id"))["C4"] == "S4c"


def test_invoice_360_keeps_every_invoice(company):
    wide = facts.invoice_360(company)
    assert rows(wide, "invoice_id", "product_name", "paid_amount") == [
        ("I1", "Product", 100.0), ("I2", "Product", None), ("I3", "Product", None), ("I4", "Product", 10.0),
    ]


# --- order -------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, a third of them with key 7 and value 7."""
    value = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 101)
    return spark.range(0, 3000, 1, 6).select("id", value.cast("double").alias("value"), value.cast("int").alias("key"))


def test_dense_numbers_follow_the_order(skewed):
    numbered = ordering.dense_numbers(skewed, [F.col("value").desc(), F.col("id").asc()]).collect()
    expected = sorted(numbered, key=lambda r: (-r.value, r.id))
    assert [r.sequence for r in expected] == list(range(1, 3001))


def test_rank_equals_brute_force(skewed):
    with_null = skewed.withColumn("value", F.when(F.col("id") % 50 != 0, F.col("value")))
    for ascending in (True, False):
        ranked = ordering.exact_rank(with_null, "value", ascending).collect()
        values = sorted(r.value for r in ranked if r.value is not None)
        assert len(ranked) == 3000
        for r in ranked:
            if r.value is None:
                assert r["rank"] is None
            else:
                below, above = bisect_left(values, r.value), len(values) - bisect_right(values, r.value)
                assert r["rank"] == 1 + (below if ascending else above)


def test_bottom_rows_break_ties_by_key_and_put_null_last(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 0.5)], "key string, value double")
    assert [r.key for r in ordering.extreme_rows(df, "value", "key", 3).collect()] == ["d", "a", "b"]


# --- results that no size changes ---------------------------------------------


def test_nested_invoices_are_whole_and_in_order(make):
    dates = [dt.date(2026, 1, 1), dt.date(2026, 1, 2)]
    many = make(
        "invoices",
        *[
            {"invoice_id": f"I{i:05d}", "customer_id": "hot" if i % 3 else "C", "invoice_date": dates[i % 2], "amount": 1.0}
            for i in range(25_000)
        ],
    )
    nested = customer.invoices_nested(many)
    assert nested.count() == 4
    flat = nested.select("customer_id", "invoice_date", F.explode("invoices.invoice_id").alias("invoice_id"))
    assert rows(flat) == rows(many, "customer_id", "invoice_date", "invoice_id")
    for row in nested.collect():
        assert [i.invoice_id for i in row.invoices] == sorted(i.invoice_id for i in row.invoices)


def test_units_outside_the_bound_are_an_error(spark):
    events = spark.range(200).select(F.lit(1).alias("sub"), F.lit(1).alias("period"), F.col("id").alias("unit"))
    columns = [F.col(c) for c in ("sub", "period", "unit")]
    with pytest.raises(Exception, match="0 to 119"):
        usage.usage_metering(events, *columns, F.lit(1.0), unit_bound=120).collect()


def test_customers_without_subscription_have_their_own_history(make):
    months = [dt.date(2026, 1, 1), dt.date(2026, 2, 1)]
    table = make(
        "usage_monthly",
        *[{"customer_id": c, "usage_month": m, "adoption_rate": r} for c, r in (("A", 0.9), ("B", 0.1)) for m in months],
    )
    changes = usage.usage_change(table).filter("previous_rate IS NOT NULL")
    assert rows(changes, "customer_id", "previous_rate") == [("A", 0.9), ("B", 0.1)]
    assert rows(usage.decline_streak(table), "decline_streak") == [(0,), (0,)]


def test_invoices_of_risky_subscriptions(company):
    risky = facts.at_risk_invoices(company["invoices"], company["renewal_forecasts"], TERMS)
    assert rows(risky, "invoice_id") == [("I3",)]


def test_joins_read_each_table_once(company):
    plan = facts.invoice_360(company)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 4
