"""The finance tables in SQL, each a common table expression over the driver's views."""

from __future__ import annotations

import re

YEAR_START = "TIMESTAMP '2000-08-01'"
START, END = "TIMESTAMP '2001-02-01'", "TIMESTAMP '2001-08-01'"
AS_OF = "DATE '2001-07-31'"


def cents(expression: str) -> str:
    """Exact sum of an amount in cents, 0 for no rows, as a double."""
    return f"CAST(COALESCE(SUM(CAST({expression} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def monthly(amount: str) -> str:
    """A twelfth of an amount in cents, half up, in integer arithmetic."""
    return f"CAST((2 * CAST(ROUND({amount} * 100) AS BIGINT) + 12) // 24 AS DOUBLE) / 100"


CTES = {
    "customers": """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
               c_mktsegment AS industry, n_name AS country, r_name AS segment,
               'owner-' || CAST(c_custkey % 20 AS VARCHAR) AS account_owner
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "products": """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS product_family,
               CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 12 AS DOUBLE) AS list_price_arr
        FROM part""",
    "part_spend": f"""
        SELECT o_custkey, l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS spend
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderdate < {END} GROUP BY o_custkey, l_partkey""",
    "main_product": """
        SELECT o_custkey AS buyer, l_partkey AS main_part FROM part_spend
        QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY spend DESC, l_partkey) = 1""",
    "buyers": f"""
        SELECT o_custkey AS k, MIN(CAST(o_orderdate AS DATE)) AS first_day, MAX(o_orderdate) AS last_order,
               {cents(f"CASE WHEN o_orderdate >= {YEAR_START} THEN o_totalprice END")} AS spent
        FROM orders WHERE o_orderdate < {END} GROUP BY o_custkey""",
    "terms": f"""
        SELECT k, c_acctbal, CAST(k AS VARCHAR) AS subscription_id, CAST(k AS VARCHAR) AS customer_id,
               spent AS arr, first_day AS start_date,
               {AS_OF} + CAST(1 + (k * 17) % 365 AS INTEGER) AS renewal_date,
               CAST(120 AS BIGINT) AS licensed_users, c_mktsegment AS contract_tier,
               CASE WHEN last_order >= {YEAR_START} THEN 'Active' ELSE 'Lapsed' END AS status
        FROM buyers JOIN customer ON k = c_custkey""",
    "subscriptions": """
        SELECT subscription_id, customer_id, CAST(main_part AS VARCHAR) AS product_id, arr, start_date,
               renewal_date, licensed_users, contract_tier, status
        FROM terms LEFT JOIN main_product ON k = buyer""",
    "invoices": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, CAST(o_custkey AS VARCHAR) AS customer_id,
               CAST(o_custkey AS VARCHAR) AS subscription_id, CAST(o_orderdate AS DATE) AS invoice_date,
               CAST(o_orderdate AS DATE) + 29 AS due_date,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
               CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'P' THEN 'Overdue' ELSE 'Open' END AS status,
               CASE WHEN o_orderstatus = 'F'
                    THEN CAST(o_orderdate AS DATE) + 29 - CAST(o_orderkey % 10 AS INTEGER) END AS paid_date
        FROM orders WHERE o_orderdate >= {START} AND o_orderdate < {END}""",
    "payments": """
        SELECT 'PAY-' || invoice_id AS payment_id, invoice_id, customer_id, paid_date AS payment_date, amount,
               CASE CAST(customer_id AS BIGINT) % 4 WHEN 0 THEN 'transfer' WHEN 1 THEN 'card' WHEN 2 THEN 'cheque' ELSE 'debit' END
                   AS payment_method
        FROM invoices WHERE status = 'Paid'""",
    "damaged_payments": """
        SELECT payment_id, CASE right(invoice_id, 1) WHEN '4' THEN 'X' || invoice_id ELSE invoice_id END AS invoice_id, customer_id,
               payment_date, CASE right(invoice_id, 1) WHEN '3' THEN CAST(CAST(amount AS DECIMAL(18,2)) + 0.01 AS DOUBLE)
                                  ELSE amount END AS amount, payment_method
        FROM payments, range(2) AS r(n)
        WHERE right(invoice_id, 1) <> '1' AND (n = 0 OR right(invoice_id, 1) = '2')
        UNION ALL SELECT 'PAY-' || invoice_id, invoice_id, customer_id, due_date, amount, 'card' FROM invoices
        WHERE status = 'Open' AND right(invoice_id, 1) = '5'""",
    "damaged_sums": f"""
        SELECT invoice_id, {cents("amount")} AS paid, COUNT(*) AS n FROM damaged_payments GROUP BY 1""",
    "damaged_match": """
        SELECT invoice_id, status, amount AS billed, paid,
               CASE WHEN amount IS NULL THEN 'payment_without_invoice'
                    WHEN status <> 'Paid' AND paid IS NULL THEN 'unpaid'
                    WHEN status <> 'Paid' THEN 'payment_of_unpaid_invoice'
                    WHEN paid IS NULL THEN 'paid_without_payment'
                    WHEN n > 1 THEN 'several_payments'
                    WHEN amount <> paid THEN 'amount_differs' ELSE 'matched' END AS match
        FROM invoices FULL JOIN damaged_sums USING (invoice_id)""",
    "metered": """
        SELECT CAST(user_id AS VARCHAR) AS subscription_id,
               DATE '2024-01-01' + CAST(5 * ((CAST(ts AS DATE) - DATE '2024-01-01') // 5) AS INTEGER)
                   AS usage_month,
               COUNT(DISTINCT date_trunc('hour', ts)) AS active_users,
               CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS compute_hours,
               COUNT(*) AS production_jobs
        FROM events GROUP BY 1, 2""",
    "usage_monthly": """
        SELECT subscription_id || '-' || strftime(usage_month, '%Y%m%d') AS usage_id, subscription_id,
               subscription_id AS customer_id, usage_month, CAST(120 AS BIGINT) AS licensed_users,
               active_users, CAST(active_users AS DOUBLE) / 120.0::DOUBLE AS adoption_rate,
               compute_hours, production_jobs
        FROM metered WHERE subscription_id IN (SELECT subscription_id FROM terms)""",
    "support_cases": """
        SELECT CAST(event_id AS VARCHAR) AS case_id, CAST(user_id AS VARCHAR) AS customer_id,
               CAST(user_id AS VARCHAR) AS subscription_id,
               CASE WHEN value >= 100 THEN 'Critical' WHEN value >= 50 THEN 'High'
                    WHEN value >= 20 THEN 'Medium' ELSE 'Low' END AS severity,
               CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN 'Open' ELSE 'Resolved' END AS status,
               event_type AS case_title, CAST(ts AS DATE) AS opened_date,
               CASE WHEN ts < TIMESTAMP '2024-01-24'
                    THEN CAST(ts AS DATE) + CAST(1 + event_id % 5 AS INTEGER) END AS resolved_date,
               CAST(ROUND(CAST(value AS DECIMAL(18,2)) * CAST(0.1 AS DECIMAL(2,1)), 2) AS DOUBLE) AS support_hours
        FROM events
        WHERE event_type = 'error' AND CAST(user_id AS VARCHAR) IN (SELECT subscription_id FROM terms)""",
    "cost_sums": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS cost_month,
               SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS compute,
               SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS storage,
               SUM(CAST(l_quantity AS DECIMAL(18,2)) * 1000) AS support
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderdate >= {START} AND o_orderdate < {END} GROUP BY 1, 2""",
    "cloud_costs": """
        SELECT 'COST-' || customer_id || '-' || strftime(cost_month, '%Y%m') AS cost_id,
               customer_id AS subscription_id, customer_id, cost_month,
               CAST(compute AS DOUBLE) AS compute_cost, CAST(storage AS DOUBLE) AS storage_cost,
               CAST(support AS DOUBLE) AS support_cost,
               CAST(CAST(compute AS DECIMAL(28,4)) + CAST(storage AS DECIMAL(28,4))
                    + CAST(support AS DECIMAL(28,4)) AS DOUBLE) AS total_cost
        FROM cost_sums""",
    "scored": """
        SELECT *, floor((c_acctbal + 1000) / 11000 * 100) / 100 AS p FROM terms""",
    "renewal_forecasts": """
        SELECT 'RF-' || subscription_id AS forecast_id, subscription_id, customer_id, renewal_date,
               arr AS renewal_arr, p AS renewal_probability,
               CASE WHEN p >= 0.90 THEN 'Expansion' WHEN p >= 0.70 THEN 'Likely'
                    WHEN p >= 0.55 THEN 'Watch' ELSE 'At Risk' END AS forecast_category,
               CASE WHEN p >= 0.90 THEN 'Renewal is very likely' WHEN p >= 0.70 THEN 'Renewal is likely'
                    WHEN p >= 0.55 THEN 'Renewal needs attention' ELSE 'Renewal is unlikely' END AS risk_reason,
               CASE WHEN p >= 0.90 THEN 'Prepare an expansion proposal' WHEN p >= 0.70 THEN 'Confirm renewal terms'
                    WHEN p >= 0.55 THEN 'Schedule an adoption review'
                    ELSE 'Run an executive value review' END AS recommended_action
        FROM scored""",
    "billing": f"""
        SELECT customer_id, {cents("amount")} AS billed,
               {cents("CASE WHEN status <> 'Paid' THEN amount END")} AS outstanding,
               {cents("CASE WHEN status = 'Overdue' THEN amount END")} AS overdue
        FROM invoices GROUP BY customer_id""",
    "cash": f"SELECT customer_id, {cents('amount')} AS collected FROM payments GROUP BY customer_id",
    "spend": """
        SELECT customer_id, CAST(ROUND(SUM(CAST(total_cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS cost,
               CAST(ROUND(SUM(CAST(compute_cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS compute_cost,
               CAST(ROUND(SUM(CAST(storage_cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS storage_cost,
               CAST(ROUND(SUM(CAST(support_cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS support_cost
        FROM cloud_costs GROUP BY customer_id""",
    "adoption": """
        SELECT DISTINCT customer_id, subscription_id,
               first_value(usage_month) OVER w AS first_month, first_value(adoption_rate) OVER w AS first_adoption,
               last_value(usage_month) OVER w AS last_month, last_value(adoption_rate) OVER w AS last_adoption
        FROM usage_monthly
        WINDOW w AS (PARTITION BY subscription_id ORDER BY usage_month
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "trends": """
        SELECT customer_id, first_adoption AS first_adoption_rate, last_adoption AS latest_adoption_rate,
               (last_adoption / NULLIF(first_adoption, 0) - 1) * 100 AS trend
        FROM adoption""",
    "critical": """
        SELECT customer_id, COUNT(*) AS open_critical FROM support_cases
        WHERE status = 'Open' AND severity = 'Critical' GROUP BY customer_id""",
    "active": f"SELECT customer_id, {cents('arr')} AS arr FROM terms WHERE status = 'Active' GROUP BY customer_id",
    "customer_finance_summary": f"""
        SELECT 'FP-' || c.customer_id AS profile_id, c.customer_id, c.customer_name,
               COALESCE(a.arr, 0) AS arr, {monthly("COALESCE(a.arr, 0)")} AS mrr,
               COALESCE(billed, 0) AS billed_revenue_6m, COALESCE(collected, 0) AS cash_collected_6m,
               COALESCE(outstanding, 0) AS ar_outstanding, COALESCE(overdue, 0) AS overdue_ar,
               COALESCE(cost, 0) AS cost_6m,
               ROUND((billed - COALESCE(cost, 0)) / NULLIF(billed, 0) * 100, 2) AS gross_margin_pct,
               latest_adoption_rate, ROUND(trend, 2) AS usage_trend_pct,
               COALESCE(open_critical, 0) AS open_critical_cases, f.renewal_date, f.renewal_probability,
               f.forecast_category AS renewal_category, f.risk_reason, f.recommended_action
        FROM customers c LEFT JOIN active a USING (customer_id) LEFT JOIN billing USING (customer_id)
        LEFT JOIN cash USING (customer_id) LEFT JOIN spend USING (customer_id)
        LEFT JOIN trends USING (customer_id) LEFT JOIN critical USING (customer_id)
        LEFT JOIN renewal_forecasts f USING (customer_id)""",
    "paired_costs": """
        SELECT subscription_id, total_cost,
               ROW_NUMBER() OVER (PARTITION BY subscription_id ORDER BY cost_month) AS period
        FROM cloud_costs""",
    "paired_usage": """
        SELECT subscription_id, compute_hours,
               ROW_NUMBER() OVER (PARTITION BY subscription_id ORDER BY usage_month) AS period
        FROM usage_monthly""",
    "paired": """
        SELECT c.subscription_id, c.period, total_cost, total_cost / NULLIF(compute_hours, 0) AS unit_cost
        FROM paired_costs c JOIN paired_usage u ON c.subscription_id = u.subscription_id AND c.period = u.period""",
    "cost_ends": """
        SELECT a.subscription_id, a.total_cost AS first_total_cost, z.total_cost AS last_total_cost,
               a.unit_cost AS first_unit_cost, z.unit_cost AS last_unit_cost, n.periods,
               (z.total_cost / NULLIF(a.total_cost, 0) - 1) * 100 AS total_cost_change_pct,
               (z.unit_cost / NULLIF(a.unit_cost, 0) - 1) * 100 AS unit_cost_change_pct
        FROM (SELECT subscription_id, MIN(period) AS lo, MAX(period) AS hi, COUNT(*) AS periods
              FROM paired GROUP BY 1) n
        JOIN paired a ON a.subscription_id = n.subscription_id AND a.period = n.lo
        JOIN paired z ON z.subscription_id = n.subscription_id AND z.period = n.hi""",
    "streaks": """
        SELECT subscription_id, customer_id, MAX(falls) AS decline_streak FROM (
            SELECT subscription_id, customer_id, run, SUM(fall) AS falls FROM (
                SELECT *, SUM(1 - fall) OVER (PARTITION BY subscription_id, customer_id ORDER BY usage_month) AS run FROM (
                    SELECT u.*, CASE WHEN u.adoption_rate < b.adoption_rate THEN 1 ELSE 0 END AS fall
                    FROM usage_monthly u LEFT JOIN usage_monthly b
                      ON b.subscription_id = u.subscription_id AND b.usage_month = u.usage_month - 5)) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "usage_marked": """
        SELECT u.*, EXISTS (SELECT 1 FROM usage_monthly b WHERE b.subscription_id = u.subscription_id
                            AND b.usage_month = u.usage_month - 5) AS goes_on FROM usage_monthly u""",
    "usage_stretches": """
        SELECT subscription_id, customer_id, n, MIN(usage_month) AS first_month, MAX(usage_month) AS last_month, COUNT(*) AS months
        FROM (SELECT *, SUM(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY subscription_id ORDER BY usage_month) AS n
              FROM usage_marked) GROUP BY 1, 2, 3""",
    "instances": """
        SELECT 'Customer' AS entity, customer_id AS key, customer_name AS display_name FROM customers
        UNION ALL SELECT 'Product', product_id, product_name FROM products
        UNION ALL SELECT 'Subscription', subscription_id, subscription_id FROM terms
        UNION ALL SELECT 'Invoice', invoice_id, invoice_id FROM invoices
        UNION ALL SELECT 'Payment', payment_id, payment_id FROM payments
        UNION ALL SELECT 'UsageMetric', usage_id, usage_id FROM usage_monthly
        UNION ALL SELECT 'SupportCase', case_id, case_title FROM support_cases
        UNION ALL SELECT 'CostAllocation', cost_id, cost_id FROM cloud_costs
        UNION ALL SELECT 'RenewalForecast', forecast_id, forecast_category FROM renewal_forecasts
        UNION ALL SELECT 'CustomerFinanceProfile', 'FP-' || customer_id, customer_name FROM customers""",
    "edges": """
        SELECT 'owns' AS relationship, 'Customer' AS source_entity, customer_id AS source_key,
               subscription_id AS target_key FROM terms
        UNION ALL SELECT 'isLicensedBy', 'Product', product_id, subscription_id FROM subscriptions
                  WHERE product_id IS NOT NULL
        UNION ALL SELECT 'receives', 'Customer', customer_id, invoice_id FROM invoices
        UNION ALL SELECT 'isSettledBy', 'Invoice', invoice_id, payment_id FROM payments
        UNION ALL SELECT 'records', 'Subscription', subscription_id, usage_id FROM usage_monthly
        UNION ALL SELECT 'opens', 'Customer', customer_id, case_id FROM support_cases
        UNION ALL SELECT 'incurs', 'Subscription', subscription_id, cost_id FROM cloud_costs
        UNION ALL SELECT 'has', 'Subscription', subscription_id, forecast_id FROM renewal_forecasts
        UNION ALL SELECT 'hasFinancialProfile', 'Customer', customer_id, 'FP-' || customer_id FROM customers""",
    "degrees": """
        SELECT r.relationship, i.key AS source_key, COUNT(e.target_key) AS degree
        FROM instances i JOIN (SELECT DISTINCT relationship, source_entity FROM edges) r ON i.entity = r.source_entity
        LEFT JOIN edges e ON e.relationship = r.relationship AND e.source_key = i.key
        GROUP BY 1, 2""",
}

_NAMES = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def _mentioned(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAMES.findall(sql)))


def with_tables(body: str) -> str:
    """The query with the expressions it mentions in front, each after those it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for needed in _mentioned(CTES[name]):
                if needed != name:
                    add(needed)
            order.append(name)

    for name in _mentioned(body):
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body
