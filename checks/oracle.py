"""One SQL text per query, written from the definitions of the terms."""

from __future__ import annotations

from checks.ctes import AS_OF, CTES, cents, monthly, with_tables
from ledgerlens.functions.identifiers import DEFAULT_BASE

DEGREES_SINGLE = "'has', 'hasFinancialProfile'"


def _rounded(expression: str, places: int = 2) -> str:
    return f"CAST(ROUND(SUM(CAST({expression} AS DECIMAL(18,4))), {places}) AS DOUBLE)"


def _large(amount: str) -> str:
    """Sum of an amount times a billion and one, by the digits it is written with."""
    return f"CAST(SUM(CAST(CAST({amount} * 1e9 + {amount} AS VARCHAR) AS DECIMAL(36,2))) AS DECIMAL(36,2))"


def _fk(child: str, column: str, parent: str) -> str:
    key = {"customers": "customer_id", "products": "product_id", "invoices": "invoice_id"}.get(parent, "subscription_id")
    return f"""
        SELECT '{child}' AS child, '{column}' AS "column", '{parent}' AS parent, COUNT(*) AS orphans
        FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})"""


_FK = [
    _fk("subscriptions", "customer_id", "customers"),
    _fk("subscriptions", "product_id", "products"),
    *[
        _fk(child, column, parent)
        for child in ("invoices", "usage_monthly", "support_cases", "cloud_costs", "renewal_forecasts")
        for column, parent in (("customer_id", "customers"), ("subscription_id", "subscriptions"))
    ],
    _fk("payments", "invoice_id", "invoices"),
    _fk("payments", "customer_id", "customers"),
]

_TABLES = [
    "customers", "products", "subscriptions", "invoices", "payments", "usage_monthly", "support_cases",
    "cloud_costs", "renewal_forecasts", "customer_finance_summary",
]
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in _TABLES)

_KEYS = [
    ("customers", "customer_id"),
    ("products", "product_id"),
    ("subscriptions", "subscription_id"),
    ("invoices", "invoice_id"),
    ("payments", "payment_id"),
    ("usage_monthly", "usage_id"),
    ("support_cases", "case_id"),
    ("cloud_costs", "cost_id"),
    ("renewal_forecasts", "forecast_id"),
    ("customer_finance_summary", "profile_id"),
    ("usage_monthly", "subscription_id,usage_month"),
    ("cloud_costs", "subscription_id,cost_month"),
]
_KEY_ROWS = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{k}' AS key_columns, key, COUNT(*) AS copies FROM (
        SELECT CAST({'(' + k + ')' if ',' in k else k} AS VARCHAR) AS key FROM {t}) GROUP BY key"""
    for t, k in _KEYS
)

_BROKEN = """
    SELECT * REPLACE (CASE WHEN invoice_id LIKE '%7' THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS amount,
                      CASE WHEN status = 'Overdue' THEN '2001-13-45' ELSE CAST(due_date AS VARCHAR) END AS due_date)
    FROM invoices"""

_EVIDENCE = """
    SELECT customer_id, renewal_probability, renewal_category, risk_reason,
           renewal_probability < 0.60 AS is_at_risk,
           COALESCE(usage_trend_pct < -10, FALSE) AS is_declining,
           open_critical_cases > 0 AS has_critical_case, overdue_ar > 0 AS has_overdue,
           CAST(CAST(COALESCE(usage_trend_pct < -10, FALSE) AS INTEGER)
                + CAST(open_critical_cases > 0 AS INTEGER) + CAST(overdue_ar > 0 AS INTEGER) AS INTEGER) AS drivers
    FROM customer_finance_summary"""

_BAND = "CASE WHEN renewal_probability < 0.60 THEN 'at_risk' WHEN renewal_probability < 0.75 THEN 'watch' WHEN renewal_probability IS NOT NULL THEN 'healthy' END"

_CONTEXT = {
    "subscription": ("subscriptions", "subscription_id", "arr"),
    "invoice": ("invoices", "invoice_id", "amount"),
    "case": ("support_cases", "case_id", "support_hours"),
    "usage": ("usage_monthly", "usage_id", "compute_hours"),
    "forecast": ("renewal_forecasts", "forecast_id", "renewal_arr"),
    "profile": ("customer_finance_summary", "profile_id", "ar_outstanding"),
}

_OVERDUE_FORECAST = """
    SELECT c.customer_name, i.invoice_id, i.amount, i.due_date, f.renewal_date, f.renewal_probability,
           f.forecast_category
    FROM invoices i JOIN customers c ON i.customer_id = c.customer_id
    JOIN renewal_forecasts f ON i.subscription_id = f.subscription_id WHERE i.status = 'Overdue'"""

_RECONCILE = {
    "billed": (
        "SELECT CAST(amount AS DECIMAL(18,2)) AS v FROM invoices",
        "SELECT CAST(billed_revenue_6m AS DECIMAL(18,2)) AS v FROM customer_finance_summary",
    ),
    "outstanding": (
        "SELECT CAST(amount AS DECIMAL(18,2)) AS v FROM invoices WHERE status <> 'Paid'",
        "SELECT CAST(ar_outstanding AS DECIMAL(18,2)) AS v FROM customer_finance_summary",
    ),
    "cash": (
        "SELECT CAST(amount AS DECIMAL(18,2)) AS v FROM invoices UNION ALL "
        "SELECT -CAST(amount AS DECIMAL(18,2)) AS v FROM payments",
        "SELECT CAST(amount AS DECIMAL(18,2)) AS v FROM invoices WHERE status <> 'Paid'",
    ),
}


def _reconcile(name: str) -> str:
    left, right = _RECONCILE[name]
    return f"""
        SELECT '{name}' AS check_name, CAST(l AS DOUBLE) AS left_total, CAST(r AS DOUBLE) AS right_total, l = r AS holds
        FROM (SELECT (SELECT SUM(v) FROM ({left})) AS l, (SELECT SUM(v) FROM ({right})) AS r)"""


def _quality() -> str:
    empty = "CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BOOLEAN) AS holds"
    parts = [
        f"SELECT 'rows:' || table_name AS metric, CAST(row_count AS DOUBLE) AS value, {empty} FROM ({_COUNTS})",
        f"SELECT 'billed_revenue_6m' AS metric, {cents('amount')} AS value, {empty} FROM invoices",
        f"SELECT 'cash_collected_6m' AS metric, {cents('amount')} AS value, {empty} FROM payments",
        f"SELECT 'ar_outstanding' AS metric, {cents('amount')} AS value, {empty} FROM invoices WHERE status <> 'Paid'",
        f"""SELECT 'at_risk_arr' AS metric, {cents('renewal_arr')} AS value, {empty}
            FROM renewal_forecasts WHERE renewal_probability < 0.60""",
        *[
            f"""SELECT 'check:' || check_name AS metric, left_total - right_total AS value,
                CAST(NULL AS VARCHAR) AS text, holds FROM ({_reconcile(n)})"""
            for n in _RECONCILE
        ],
        f"""SELECT 'check:orphans:' || child || ':' || "column" AS metric, CAST(orphans AS DOUBLE) AS value,
            CAST(NULL AS VARCHAR) AS text, orphans = 0 AS holds FROM ({' UNION ALL '.join(_FK)})""",
        "SELECT 'as_of_date' AS metric, CAST(NULL AS DOUBLE) AS value, '2001-07-31' AS text, CAST(NULL AS BOOLEAN) AS holds",
    ]
    return " UNION ALL ".join(parts)


_UUID_HEX = f"sha1(CAST(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('{DEFAULT_BASE}' || entity || ':' || key) AS BLOB))"

BODIES = {
    # sources and sinks
    "ingest_scan": """
        SELECT invoice_id, customer_id, subscription_id, CAST(invoice_date AS VARCHAR) AS invoice_date,
               CAST(due_date AS VARCHAR) AS due_date, CAST(amount AS VARCHAR) AS amount, status,
               CAST(paid_date AS VARCHAR) AS paid_date FROM invoices""",
    "ingest_blank_null": """
        SELECT status, COUNT(*) AS row_count, COUNT(paid_date) AS dated, CAST(0 AS BIGINT) AS blank
        FROM invoices GROUP BY status""",
    "ingest_typed": "SELECT * FROM invoices",
    "ingest_rejects": f"""
        SELECT invoice_id, amount, due_date,
               CASE WHEN due_date = '2001-13-45' AND amount = 'n/a' THEN 'due_date,amount'
                    WHEN amount = 'n/a' THEN 'amount' ELSE 'due_date' END AS bad_columns
        FROM ({_BROKEN}) WHERE amount = 'n/a' OR due_date = '2001-13-45'""",
    "ingest_accepted": "SELECT * FROM invoices WHERE invoice_id NOT LIKE '%7' AND status <> 'Overdue'",
    "ingest_broken_rows": f"""
        SELECT wrong, CAST(SUM(n) AS BIGINT) AS row_count, CAST(COALESCE(SUM(a), 0) AS DOUBLE) AS amount FROM (
            SELECT CASE right(invoice_id, 1) WHEN '1' THEN 'broken_line' WHEN '2' THEN 'broken_line'
                   WHEN '3' THEN 'broken_line' WHEN '4' THEN 'amount' WHEN '5' THEN 'amount'
                   WHEN '6' THEN 'invoice_id' ELSE '' END AS wrong, 1 AS n,
                   CASE WHEN right(invoice_id, 1) NOT IN ('1', '3', '4', '5') THEN CAST(amount AS DECIMAL(18,2)) END AS a
            FROM invoices
            UNION ALL SELECT 'invoice_date,broken_line', 1, NULL FROM invoices WHERE right(invoice_id, 1) = '3'
            ) GROUP BY wrong""",
    "load_audit": _COUNTS,
    "load_refused": f"SELECT table_name, row_count, TRUE AS refused FROM ({_COUNTS})",
    "load_interrupted": f"SELECT table_name, row_count, TRUE AS interrupted FROM ({_COUNTS})",
    "load_check": f"""
        SELECT table_name, row_count AS expected_rows, row_count AS found_rows, TRUE AS schema_ok, TRUE AS content_ok,
               TRUE AS complete
        FROM ({_COUNTS})""",
    "stored_portfolio": f"""
        SELECT renewal_category, COUNT(*) AS customers, {cents("arr")} AS arr
        FROM customer_finance_summary GROUP BY renewal_category""",
    "csv_round_trip": f"SELECT table_name, row_count, CAST(0 AS BIGINT) AS rejected, TRUE AS same FROM ({_COUNTS})",
    "csv_round_trip_texts": """
        SELECT 'customers' AS table_name, COUNT(*) AS row_count, CAST(0 AS BIGINT) AS rejected, TRUE AS same FROM customers""",
    # billing
    "billing_schedule": f"""
        SELECT subscription_id, customer_id, {monthly("arr")} AS amount, CAST(month AS DATE) AS invoice_date
        FROM terms, generate_series(TIMESTAMP '2001-02-01', TIMESTAMP '2001-07-01', INTERVAL 1 MONTH) AS m(month)""",
    "mrr_by_subscription": f"SELECT subscription_id, arr, {monthly('arr')} AS mrr FROM terms",
    "invoice_due_dates": "SELECT invoice_id, invoice_date, invoice_date + 29 AS due_date FROM invoices",
    "invoice_settlement": "SELECT invoice_id, status, due_date, paid_date FROM invoices",
    "invoice_ar_class": f"""
        SELECT CASE status WHEN 'Paid' THEN 'paid' WHEN 'Overdue' THEN 'overdue' ELSE 'outstanding' END AS ar_class,
               COUNT(*) AS invoices, {cents("amount")} AS amount FROM invoices GROUP BY 1""",
    "dense_ids": """
        SELECT customer_id, invoice_date, invoice_id,
               ROW_NUMBER() OVER (ORDER BY customer_id, invoice_date, invoice_id) AS sequence,
               'INV' || CASE WHEN sequence < 10000 THEN lpad(CAST(sequence AS VARCHAR), 4, '0')
                             ELSE CAST(sequence AS VARCHAR) END AS dense_id
        FROM invoices""",
    "payments_from_invoices": "SELECT * FROM payments",
    "payment_method_mix": f"""
        SELECT payment_method, COUNT(*) AS payments, {cents("amount")} AS amount FROM payments GROUP BY 1""",
    "invoice_payment_mismatch": """
        SELECT i.invoice_id, i.status, i.amount AS billed, p.amount AS paid, '' AS match
        FROM invoices i FULL JOIN payments p ON i.invoice_id = p.invoice_id
        WHERE i.invoice_id IS NULL OR (i.status = 'Paid') <> (p.invoice_id IS NOT NULL) OR i.amount <> p.amount""",
    "mismatch_damaged": "SELECT * FROM damaged_match WHERE match NOT IN ('matched', 'unpaid')",
    "orphans_damaged": """
        SELECT payment_id, invoice_id, amount FROM damaged_payments p
        WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.invoice_id = p.invoice_id)""",
    "duplicates_damaged": """
        SELECT 'payments' AS table_name, 'payment_id' AS key_columns, payment_id AS key, COUNT(*) AS copies
        FROM damaged_payments GROUP BY payment_id HAVING COUNT(*) > 1""",
    "cash_damaged": f"""
        SELECT customer_id, billed, collected, outstanding,
               CAST(CAST(billed AS DECIMAL(18,2)) - CAST(collected AS DECIMAL(18,2)) - CAST(outstanding AS DECIMAL(18,2)) AS DOUBLE)
                   AS difference
        FROM (SELECT customer_id, COALESCE(billed, 0) AS billed, COALESCE(collected, 0) AS collected, COALESCE(outstanding, 0) AS outstanding
              FROM billing FULL JOIN (SELECT customer_id, {cents("amount")} AS collected FROM damaged_payments GROUP BY 1) USING (customer_id))
        WHERE difference <> 0""",
    "invoice_payment_match": f"""
        SELECT CASE WHEN p.invoice_id IS NULL THEN 'unpaid' ELSE 'matched' END AS match, COUNT(*) AS invoices,
               {cents("i.amount")} AS billed, {cents("p.amount")} AS paid
        FROM invoices i LEFT JOIN payments p ON i.invoice_id = p.invoice_id GROUP BY 1""",
    # usage and cost
    "usage_metering": "SELECT * FROM metered",
    "adoption_rate": "SELECT usage_id, licensed_users, active_users, adoption_rate FROM usage_monthly",
    "period_keys": """
        SELECT subscription_id || '-' || strftime(cost_month, '%Y%m') AS period_key, cost_id AS cost_key
        FROM cloud_costs""",
    "support_load_tier": """
        SELECT subscription_id, contract_tier,
               CAST(CASE contract_tier WHEN 'AUTOMOBILE' THEN 1.5 WHEN 'MACHINERY' THEN 1.2 ELSE 1.0 END AS DOUBLE)
                   AS support_load FROM terms""",
    "cost_allocation": """
        SELECT subscription_id, customer_id, cost_month, CAST(compute AS DOUBLE) AS compute_cost,
               CAST(storage AS DOUBLE) AS storage_cost, CAST(support AS DOUBLE) AS support_cost,
               CAST(compute + storage + support AS DOUBLE) AS total_cost
        FROM (SELECT u.subscription_id, u.customer_id, u.usage_month AS cost_month,
                     CAST(ROUND(CAST(compute_hours AS DECIMAL(18,4)) * 4.2, 2) AS DECIMAL(18,2)) AS compute,
                     CAST(610 + 12.5 * ((usage_month - DATE '2024-01-01') // 5) AS DECIMAL(18,2)) AS storage,
                     CAST(CASE contract_tier WHEN 'AUTOMOBILE' THEN 1410 WHEN 'MACHINERY' THEN 1128 ELSE 940 END
                          + 27 * ((usage_month - DATE '2024-01-01') // 5) AS DECIMAL(18,2)) AS support
              FROM usage_monthly u JOIN terms t ON u.subscription_id = t.subscription_id)""",
    "cost_trend": "SELECT * FROM cost_ends",
    "cost_change": """
        SELECT subscription_id, period, total_cost, unit_cost,
               total_cost - LAG(total_cost) OVER w AS total_cost_change,
               unit_cost - LAG(unit_cost) OVER w AS unit_cost_change
        FROM paired WINDOW w AS (PARTITION BY subscription_id ORDER BY period)""",
    # customer aggregates
    "billed_by_customer": f"""
        SELECT customer_id, {cents("amount")} AS billed_revenue_6m, COUNT(*) AS invoices FROM invoices GROUP BY 1""",
    "collected_by_customer": f"""
        SELECT customer_id, {cents("amount")} AS cash_collected_6m, COUNT(*) AS payments FROM payments GROUP BY 1""",
    "ar_by_customer": "SELECT customer_id, outstanding AS ar_outstanding, overdue AS overdue_ar FROM billing",
    "cost_by_customer": "SELECT customer_id, cost AS cost_6m, compute_cost, storage_cost, support_cost FROM spend",
    "open_critical_cases": """
        SELECT customer_id, COUNT(*) FILTER (status = 'Open' AND severity = 'Critical') AS open_critical_cases
        FROM support_cases GROUP BY customer_id""",
    "first_last_adoption": "SELECT * FROM adoption",
    "usage_trend": """
        SELECT customer_id, first_adoption_rate, latest_adoption_rate, trend AS usage_trend_pct FROM trends""",
    "gross_margin": """
        SELECT customer_id, billed AS billed_revenue_6m, COALESCE(cost, 0) AS cost_6m,
               (billed - COALESCE(cost, 0)) / NULLIF(billed, 0) * 100 AS gross_margin_pct
        FROM billing LEFT JOIN spend USING (customer_id)""",
    "current_subscription": """
        SELECT customer_id, subscription_id, renewal_date, product_id, arr, status FROM subscriptions
        QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY renewal_date DESC, subscription_id DESC) = 1""",
    "customer_finance_summary": "SELECT * FROM customer_finance_summary",
    "portfolio_totals": f"""
        SELECT {cents("billed_revenue_6m")} AS billed_revenue_6m, {cents("cash_collected_6m")} AS cash_collected_6m,
               {cents("ar_outstanding")} AS ar_outstanding,
               {cents("CASE WHEN renewal_probability < 0.60 THEN arr ELSE 0 END")} AS at_risk_arr
        FROM customer_finance_summary""",
    "stored_summary": "SELECT * FROM customer_finance_summary",
    "stored_quarter": f"""
        SELECT customer_id, COALESCE(billed, 0) AS billed, COALESCE(outstanding, 0) AS outstanding, COALESCE(cost, 0) AS cost
        FROM (SELECT customer_id, {cents("amount")} AS billed, {cents("CASE WHEN status <> 'Paid' THEN amount END")} AS outstanding
              FROM invoices WHERE invoice_date >= DATE '2001-04-01' AND invoice_date < DATE '2001-07-01' GROUP BY 1) i
        FULL JOIN (SELECT customer_id, {_rounded("total_cost")} AS cost FROM cloud_costs
                   WHERE cost_month BETWEEN DATE '2001-04-01' AND DATE '2001-06-01' GROUP BY 1) c USING (customer_id)""",
    "portfolio_exact": f"""
        SELECT CAST((SELECT {_large("amount")} FROM invoices) AS VARCHAR) AS billed_revenue_6m,
               CAST((SELECT {_large("amount")} FROM payments) AS VARCHAR) AS cash_collected_6m,
               CAST((SELECT {_large("amount")} FROM invoices WHERE status <> 'Paid') AS VARCHAR) AS ar_outstanding,
               CAST((SELECT {_large("t.arr")} FROM terms t JOIN renewal_forecasts f USING (customer_id)
                     WHERE t.status = 'Active' AND renewal_probability < 0.60) AS VARCHAR) AS at_risk_arr""",
    "portfolio_counts": f"""
        SELECT COUNT(DISTINCT customer_id) AS active_customers, COUNT(*) AS active_subscriptions,
               {cents("arr")} AS total_arr FROM terms WHERE status = 'Active'""",
    "active_arr": f"""
        SELECT {cents("arr")} AS active_arr, COUNT(*) AS subscriptions FROM terms WHERE status = 'Active'""",
    "invoices_nested": f"""
        SELECT customer_id, invoice_date, COUNT(*) AS invoices, {cents("amount")} AS amount,
               MIN(invoice_id) AS first_invoice, MAX(invoice_id) AS last_invoice
        FROM invoices GROUP BY customer_id, invoice_date""",
    # joins
    "forecast_lookup": """
        SELECT customer_id, customer_name, f.renewal_date, f.renewal_probability,
               f.forecast_id IS NOT NULL AS has_forecast
        FROM customers LEFT JOIN renewal_forecasts f USING (customer_id)""",
    "customer_ar_zero_fill": """
        SELECT customer_id, customer_name, ar_outstanding, overdue_ar FROM customer_finance_summary""",
    "fk_orphans": """
        SELECT subscription_id, product_id FROM subscriptions s
        WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = s.product_id)""",
    "at_risk_invoices": """
        SELECT * FROM invoices WHERE subscription_id IN (
            SELECT subscription_id FROM renewal_forecasts WHERE renewal_probability < 0.60)""",
    "invoice_360": """
        SELECT i.invoice_id, i.customer_id, customer_name, segment, i.subscription_id, contract_tier, s.product_id,
               product_name, product_family, i.invoice_date, i.due_date, i.amount, i.status,
               p.amount AS paid_amount, p.payment_date AS last_payment_date
        FROM invoices i LEFT JOIN customers c ON i.customer_id = c.customer_id
        LEFT JOIN subscriptions s ON i.subscription_id = s.subscription_id
        LEFT JOIN products d ON s.product_id = d.product_id
        LEFT JOIN payments p ON i.invoice_id = p.invoice_id""",
    # rules
    "at_risk_renewals": "SELECT * FROM renewal_forecasts WHERE renewal_probability < 0.60",
    "watch_renewals": "SELECT * FROM renewal_forecasts WHERE renewal_probability >= 0.60 AND renewal_probability < 0.75",
    "renewal_bands": f"""
        SELECT {_BAND} AS band, COUNT(*) AS renewals, {cents("renewal_arr")} AS renewal_arr
        FROM renewal_forecasts GROUP BY 1""",
    "declining_adoption": """
        SELECT customer_id, latest_adoption_rate, usage_trend_pct FROM customer_finance_summary
        WHERE usage_trend_pct < -10""",
    "overdue_invoices": "SELECT * FROM invoices WHERE status = 'Overdue'",
    "renewals_next_90d": f"""
        SELECT * FROM renewal_forecasts WHERE renewal_date BETWEEN {AS_OF} AND {AS_OF} + 90""",
    "negative_margin": """
        SELECT customer_id, billed_revenue_6m, cost_6m, gross_margin_pct FROM customer_finance_summary
        WHERE gross_margin_pct < 0""",
    # order
    "margin_rank": """
        SELECT customer_id, gross_margin_pct, RANK() OVER (ORDER BY gross_margin_pct DESC) AS margin_rank
        FROM customer_finance_summary WHERE gross_margin_pct IS NOT NULL""",
    "margin_bottom3": """
        SELECT customer_id, customer_name, billed_revenue_6m, cost_6m, gross_margin_pct FROM customer_finance_summary
        ORDER BY gross_margin_pct NULLS LAST, customer_id LIMIT 3""",
    "usage_change": """
        SELECT u.subscription_id, u.customer_id, u.usage_month, u.adoption_rate, b.adoption_rate AS previous_rate,
               u.adoption_rate - b.adoption_rate AS rate_change
        FROM usage_monthly u LEFT JOIN usage_monthly b
          ON b.subscription_id = u.subscription_id AND b.usage_month = u.usage_month - 5""",
    "usage_islands": """
        SELECT a.subscription_id, a.customer_id, a.first_month, a.last_month, a.months,
               CAST((a.first_month - b.last_month) // 5 - 1 AS BIGINT) AS missing_before
        FROM usage_stretches a LEFT JOIN usage_stretches b ON b.subscription_id = a.subscription_id AND b.n = a.n - 1""",
    "usage_active_users": """
        SELECT DATE '2024-01-01' + CAST(5 * ((CAST(ts AS DATE) - DATE '2024-01-01') // 5) AS INTEGER) AS usage_month,
               COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1
        UNION ALL SELECT NULL, COUNT(DISTINCT user_id) FROM events""",
    # quality
    "fk_report": " UNION ALL ".join(_FK),
    "table_rows": _COUNTS,
    **{f"reconcile_{n}": _reconcile(n) for n in _RECONCILE},
    "reconcile_cash_by_customer": """
        SELECT customer_id, billed, COALESCE(collected, 0) AS collected, outstanding, CAST(0 AS DOUBLE) AS difference
        FROM billing LEFT JOIN cash USING (customer_id)""",
    "quality_report": _quality(),
    "quality_document": f"""
        SELECT '2001-07-31' AS as_of_date, (SELECT {cents('amount')} FROM invoices) AS billed_revenue_6m,
               (SELECT {cents('amount')} FROM payments) AS cash_collected_6m,
               (SELECT {cents('amount')} FROM invoices WHERE status <> 'Paid') AS ar_outstanding,
               (SELECT {cents('renewal_arr')} FROM renewal_forecasts WHERE renewal_probability < 0.60) AS at_risk_arr,
               (SELECT string_agg(table_name || '=' || row_count, ',' ORDER BY table_name) FROM ({_COUNTS})) AS table_rows,
               (SELECT COUNT(*) FROM ({_quality()}) WHERE NOT holds) AS failed_checks""",
    "duplicate_keys": f"SELECT * FROM ({_KEY_ROWS}) WHERE copies > 1",
    "key_report": f"""
        SELECT table_name, key_columns, CAST(SUM(copies) AS BIGINT) AS row_count, COUNT(*) AS distinct_keys,
               COUNT(*) FILTER (copies > 1) AS repeated_keys FROM ({_KEY_ROWS}) GROUP BY 1, 2""",
    "relationship_cardinality": f"""
        SELECT relationship, COUNT(*) AS sources, CAST(SUM(degree) AS BIGINT) AS edges, MAX(degree) AS max_targets,
               COUNT(*) FILTER (degree = 0) AS without_target,
               COUNT(*) FILTER (degree > 1 AND relationship IN ({DEGREES_SINGLE})) AS violations
        FROM degrees GROUP BY relationship""",
    "category_band_mismatch": f"""
        SELECT forecast_id, subscription_id, renewal_probability, forecast_category, band FROM (
            SELECT *, {_BAND} AS band FROM renewal_forecasts)
        WHERE band <> CASE forecast_category WHEN 'At Risk' THEN 'at_risk' WHEN 'Watch' THEN 'watch' ELSE 'healthy' END""",
    "unexplained_risk": f"""
        SELECT customer_id, renewal_probability, renewal_category FROM ({_EVIDENCE}) WHERE is_at_risk AND drivers = 0""",
    # semantic model
    "entity_instances": "SELECT * FROM instances",
    "relationship_edges": "SELECT relationship, source_key, target_key FROM edges",
    "stable_ids": """
        SELECT entity, key, CAST(GREATEST(h % 9223372036854775808, 1) AS BIGINT) AS id FROM (
            SELECT entity, key, CAST(CAST('0x' || substr(sha256(entity || ':' || key), 1, 16) AS UBIGINT) AS HUGEINT) AS h
            FROM instances)""",
    "stable_uuids": f"""
        SELECT entity, key, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-'
               || substr('89ab', CAST(instr('0123456789abcdef', substr(d, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1)
               || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS uuid
        FROM (SELECT entity, key, {_UUID_HEX} AS d FROM instances)""",
    "entity_degree": "SELECT * FROM degrees",
    "traverse_customer_invoice": """
        SELECT customer_name AS "Customer_customer_name", segment AS "Customer_segment",
               invoice_id AS "Invoice_invoice_id", amount AS "Invoice_amount", status AS "Invoice_status"
        FROM invoices JOIN customers USING (customer_id)""",
    "traverse_two_hop": """
        SELECT customer_name AS "Customer_customer_name", subscription_id AS "Subscription_subscription_id",
               arr AS "Subscription_arr", product_name AS "Product_product_name"
        FROM subscriptions JOIN customers USING (customer_id) JOIN products USING (product_id)""",
    "traverse_usage": """
        SELECT customer_name AS "Customer_customer_name", usage_id AS "UsageMetric_usage_id",
               adoption_rate AS "UsageMetric_adoption_rate"
        FROM usage_monthly u JOIN terms t ON u.subscription_id = t.subscription_id
        JOIN customers c ON t.customer_id = c.customer_id""",
    "traverse_cost": """
        SELECT customer_name AS "Customer_customer_name", cost_id AS "CostAllocation_cost_id",
               total_cost AS "CostAllocation_total_cost"
        FROM cloud_costs u JOIN terms t ON u.subscription_id = t.subscription_id
        JOIN customers c ON t.customer_id = c.customer_id""",
    "traverse_forecast": """
        SELECT customer_name AS "Customer_customer_name", forecast_id AS "RenewalForecast_forecast_id",
               renewal_probability AS "RenewalForecast_renewal_probability"
        FROM renewal_forecasts JOIN customers USING (customer_id)""",
    "traverse_payment": """
        SELECT customer_name AS "Customer_customer_name", i.invoice_id AS "Invoice_invoice_id",
               payment_id AS "Payment_payment_id", payment_date AS "Payment_payment_date"
        FROM payments p JOIN invoices i ON p.invoice_id = i.invoice_id
        JOIN customers c ON i.customer_id = c.customer_id""",
    "traverse_cases": """
        SELECT customer_name AS "Customer_customer_name", case_id AS "SupportCase_case_id", u.status AS "SupportCase_status"
        FROM support_cases u JOIN customers c ON u.customer_id = c.customer_id""",
    "traverse_profile": """
        SELECT c.customer_name AS "Customer_customer_name", profile_id AS "CustomerFinanceProfile_profile_id"
        FROM customer_finance_summary p JOIN customers c ON p.customer_id = c.customer_id""",
    "traverse_product": """
        SELECT product_name AS "Product_product_name", s.subscription_id AS "Subscription_subscription_id"
        FROM products p JOIN subscriptions s ON p.product_id = s.product_id""",
    "traverse_group_by": f"""
        SELECT segment AS "Customer_segment", status AS "Invoice_status", COUNT(*) AS invoices, {cents("amount")} AS amount
        FROM invoices JOIN customers USING (customer_id) GROUP BY 1, 2""",
    "customer_context": " UNION ALL ".join(
        f"""SELECT customer_id, '{section}' AS section, COUNT(*) AS records,
               CAST(SUM(CAST({measure} AS DECIMAL(18,4))) AS DOUBLE) AS measure, MIN({key}) AS first_key
            FROM {table} GROUP BY customer_id"""
        for section, (table, key, measure) in _CONTEXT.items()
    ),
    "context_documents": "SELECT r.customer_id, CAST(0 AS BIGINT) AS page, "
    + ", ".join(
        f"(SELECT string_agg({key}, ',' ORDER BY {key}) FROM {table} t WHERE t.customer_id = r.customer_id) AS {section}"
        for section, (table, key, _) in _CONTEXT.items()
    )
    + " FROM (SELECT DISTINCT customer_id FROM renewal_forecasts WHERE renewal_probability < 0.60) r",
    "traverse_again": """
        SELECT product_name AS "Product_product_name", a.subscription_id AS "Subscription_subscription_id",
               customer_name AS "Customer_customer_name", b.subscription_id AS "Subscription2_subscription_id",
               b.status AS "Subscription2_status"
        FROM products JOIN subscriptions a USING (product_id) JOIN customers c ON c.customer_id = a.customer_id
        JOIN subscriptions b ON b.customer_id = c.customer_id""",
    "traverse_filtered": """
        SELECT customer_name AS "Customer_customer_name", i.invoice_id AS "Invoice_invoice_id", i.amount AS "Invoice_amount",
               payment_id AS "Payment_payment_id"
        FROM customers c JOIN invoices i USING (customer_id) JOIN payments p ON p.invoice_id = i.invoice_id
        WHERE industry = 'BUILDING' AND date_trunc('month', payment_date) = DATE '2001-04-01'""",
    # questions
    "q_at_risk": """
        SELECT customer_name, arr, renewal_date, renewal_probability, usage_trend_pct, open_critical_cases,
               overdue_ar, risk_reason, recommended_action
        FROM customer_finance_summary WHERE renewal_probability < 0.60 ORDER BY renewal_probability""",
    "q_declining_critical": """
        SELECT customer_name, arr, latest_adoption_rate, usage_trend_pct, open_critical_cases, renewal_probability,
               recommended_action
        FROM customer_finance_summary WHERE usage_trend_pct < -10 AND open_critical_cases > 0 ORDER BY arr DESC""",
    "q_profitability": """
        SELECT customer_name, billed_revenue_6m, cost_6m, gross_margin_pct, arr
        FROM customer_finance_summary ORDER BY gross_margin_pct""",
    "q_overdue_forecast": _OVERDUE_FORECAST,
    "q_overdue_at_risk": _OVERDUE_FORECAST + " AND f.renewal_probability < 0.60",
    "q_urgent_renewals": f"""
        SELECT customer_id, customer_name, arr, renewal_date, usage_trend_pct, open_critical_cases, renewal_probability
        FROM customer_finance_summary WHERE usage_trend_pct < -10 AND open_critical_cases > 0
        AND renewal_date BETWEEN {AS_OF} AND {AS_OF} + 90""",
    "q_margin_drivers": """
        SELECT customer_id, customer_name, billed_revenue_6m, cost_6m, gross_margin_pct,
               compute_cost / NULLIF(cost_6m, 0) AS compute_share, storage_cost / NULLIF(cost_6m, 0) AS storage_share,
               support_cost / NULLIF(cost_6m, 0) AS support_share
        FROM (SELECT * FROM customer_finance_summary WHERE gross_margin_pct IS NOT NULL
              ORDER BY gross_margin_pct, customer_id LIMIT 3) LEFT JOIN spend USING (customer_id)""",
    "q_forecast_evidence": _EVIDENCE,
    "q_next_actions": """
        SELECT customer_id, customer_name, arr, renewal_probability, usage_trend_pct, open_critical_cases, overdue_ar,
               recommended_action
        FROM customer_finance_summary WHERE renewal_probability < 0.60""",
    "q_executive_briefing": f"""
        SELECT band, customers, arr, ar_outstanding, overdue_ar, open_critical_cases,
               (billed - cost) / NULLIF(billed, 0) * 100 AS margin_pct
        FROM (SELECT {_BAND} AS band, COUNT(*) AS customers, {cents("arr")} AS arr,
                     {cents("ar_outstanding")} AS ar_outstanding, {cents("overdue_ar")} AS overdue_ar,
                     CAST(SUM(open_critical_cases) AS BIGINT) AS open_critical_cases,
                     {cents("billed_revenue_6m")} AS billed, {cents("cost_6m")} AS cost
              FROM customer_finance_summary GROUP BY 1)""",
    "q_expansion": """
        SELECT customer_id, customer_name, arr, renewal_probability, recommended_action
        FROM customer_finance_summary WHERE renewal_category = 'Expansion'""",
    "q_usage_down_cost_up": """
        SELECT s.customer_id, s.latest_adoption_rate, s.usage_trend_pct, e.unit_cost_change_pct
        FROM customer_finance_summary s JOIN terms t ON t.customer_id = s.customer_id
        JOIN cost_ends e ON e.subscription_id = t.subscription_id
        WHERE s.usage_trend_pct < -10 AND e.unit_cost_change_pct > 0""",
    "q_decline_streak": """
        SELECT subscription_id, customer_id, CAST(decline_streak AS BIGINT) AS decline_streak FROM streaks
        WHERE decline_streak >= 2""",
    **{
        f"q_{by}_rollup": f"""
        SELECT {by}, COUNT(*) AS customers, {cents("s.arr")} AS arr,
               {cents("billed_revenue_6m")} AS billed_revenue_6m, {cents("cost_6m")} AS cost_6m,
               {cents("ar_outstanding")} AS ar_outstanding,
               CAST(SUM(open_critical_cases) AS BIGINT) AS open_critical_cases
        FROM customer_finance_summary s JOIN customers c ON c.customer_id = s.customer_id GROUP BY {by}"""
        for by in ("segment", "industry", "country")
    },
}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(body) for name, body in BODIES.items()}


__all__ = ["BODIES", "CTES", "oracle_sql"]
