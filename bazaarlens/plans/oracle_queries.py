"""SQL twins by query name (see `oracle` for the shared table expressions)."""

from __future__ import annotations

from bazaarlens.plans.oracle import THRESHOLD, with_ctes

ORACLE: dict[str, str] = {}


def _sql(name: str, text: str) -> None:
    ORACLE[name] = with_ctes(text)


def r(expression: str, digits: int, alias: str | None = None) -> str:
    return f"round(({expression}) + 1e-8, {digits}) AS {alias or expression}"


def _replace(source: str, **digits: int) -> str:
    """SELECT * with some columns rounded."""
    changed = ", ".join(r(c, d) for c, d in digits.items())
    return f"SELECT * REPLACE ({changed}) FROM {source}"


ITEM_MONEY = dict(items_subtotal=4, items_freight=4, items_revenue=4, avg_unit_price=6, max_unit_price=4)

# ---------------------------------------------------------------- silver -----------
_sql("row_counts", """
SELECT 'orders' AS table_name, count(*) AS row_count FROM raw_orders
UNION ALL SELECT 'order_items', count(*) FROM lineitem
UNION ALL SELECT 'order_payments', count(*) FROM lineitem
UNION ALL SELECT 'order_reviews', count(*) FROM raw_reviews
UNION ALL SELECT 'customers', count(*) FROM raw_customers
UNION ALL SELECT 'products', count(*) FROM part
UNION ALL SELECT 'sellers', count(*) FROM raw_sellers
UNION ALL SELECT 'geolocation', count(*) FROM raw_geo
UNION ALL SELECT 'category_translation', count(*) FROM raw_translation""")

_sql("customers_first_address", "SELECT * FROM s_customers")
_sql("customer_orders_bridge", """
SELECT customer_id AS shipping_id, customer_unique_id, zip AS customer_zip_code_prefix,
  city AS customer_city, state AS customer_state
FROM raw_customers""")
_sql("geo_centroid_modal", _replace("s_geo", lat=6, lng=6))
_sql("products_clean", """
SELECT product_id, category_pt, coalesce(t.label_en, category_pt) AS category_en, name_length,
  description_length, n_photos, weight_g, length_cm, height_cm, width_cm,
  CAST(length_cm AS BIGINT) * height_cm * width_cm AS volume_cm3,
  category_pt IS NULL OR weight_g IS NULL OR length_cm IS NULL AS has_missing_attributes
FROM (SELECT p_partkey AS product_id, p_brand AS category_pt, CAST(length(p_name) AS INTEGER) AS name_length,
        CAST(length(p_type) AS INTEGER) AS description_length, p_size % 6 AS n_photos,
        CASE WHEN p_size % 9 <> 0 THEN p_size * 100 END AS weight_g,
        CASE WHEN p_size % 10 <> 0 THEN p_size + 2 END AS length_cm,
        CASE WHEN p_size % 7 <> 0 THEN p_size + 1 END AS height_cm, p_size AS width_cm FROM part) p
LEFT JOIN raw_translation t ON t.label = p.category_pt""")
_sql("sellers_located", _replace("s_sellers", lat=6, lng=6))
_sql("orders_enriched", "SELECT * FROM s_orders")
_sql("items_enriched", """
SELECT * REPLACE (CAST(order_item_id AS INTEGER) AS order_item_id,
  round(freight_value + 1e-8, 4) AS freight_value, round(line_revenue + 1e-8, 4) AS line_revenue)
FROM s_items""")
_sql("payments_clean", """
SELECT order_id, CAST(payment_sequential AS INTEGER) AS payment_sequential, payment_type,
  payment_installments, round(payment_value + 1e-8, 4) AS payment_value
FROM raw_payments""")
_sql("reviews_latest", "SELECT * FROM s_reviews")

# ------------------------------------------------------------------ gold -----------
_sql("payment_rollup", _replace("pay_roll", payment_total=4))
_sql("item_rollup", _replace("item_roll", **ITEM_MONEY))
_sql("fact_orders", _replace("facts", payment_total=4, **ITEM_MONEY))
_sql("customer_sequence", """
SELECT order_id, customer_order_rank, customer_total_orders, days_since_prior_order, is_first_purchase
FROM facts""")
_sql("dim_customer", _replace("d_customer", lifetime_revenue=4, avg_order_value=6, avg_review_score=6, pct_on_time=6))
_sql("dim_seller", _replace("d_seller", seller_lat=6, seller_lng=6, lifetime_revenue=4, avg_line_revenue=6,
                            avg_review_score=6))
_sql("dim_seller_as_of", _replace("d_seller_early", seller_lat=6, seller_lng=6, lifetime_revenue=4, avg_line_revenue=6,
                                  avg_review_score=6))
_sql("layers_customer_value", f"""
SELECT customer_unique_id, n_orders, {r("lifetime_revenue", 4)}, {r("pct_on_time", 6)}, first_category, {r("repeat_revenue", 4)}, n_repeat_orders
FROM d_customer JOIN repeats USING (customer_unique_id)""")

_sql("ntile_distributed", """
SELECT o_orderkey, o_totalprice, ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS quartile FROM orders""")

# ------------------------------------------------------------- analytics -----------
_sql("cohort_retention", _replace("retention", retention_rate=6))
_sql("cohort_retention_spine", """
SELECT s.cohort_month, CAST(m.month AS DATE) AS activity_month,
  date_diff('month', s.cohort_month, CAST(m.month AS DATE)) AS month_offset, s.n AS cohort_size,
  coalesce(r.active_customers, 0) AS active_customers,
  round(coalesce(r.active_customers, 0) / CAST(s.n AS DOUBLE) + 1e-8, 6) AS retention_rate
FROM (SELECT cohort_month, count(*) AS n FROM first_months GROUP BY cohort_month) s
CROSS JOIN (SELECT unnest(generate_series((SELECT min(purchase_month) FROM s_orders),
    (SELECT max(purchase_month) FROM s_orders), INTERVAL 1 MONTH)) AS month) m
LEFT JOIN retention r ON r.cohort_month = s.cohort_month AND r.activity_month = m.month
WHERE m.month >= s.cohort_month""")
_sql("order_funnel", f"""
SELECT purchase_week, n_created, n_approved, n_carrier, n_delivered, n_on_time, n_lost,
  {r("n_approved / nullif(CAST(n_created AS DOUBLE), 0)", 6, "pct_created_to_approved")},
  {r("n_carrier / nullif(CAST(n_approved AS DOUBLE), 0)", 6, "pct_approved_to_carrier")},
  {r("n_delivered / nullif(CAST(n_carrier AS DOUBLE), 0)", 6, "pct_carrier_to_delivered")},
  {r("n_on_time / nullif(CAST(n_delivered AS DOUBLE), 0)", 6, "pct_delivered_on_time")},
  {r("n_lost / nullif(CAST(n_created AS DOUBLE), 0)", 6, "pct_lost")},
  {r("h1", 6, "avg_hours_to_approved")}, {r("h2", 6, "avg_hours_to_carrier")}, {r("h3", 6, "avg_hours_to_delivered")}
FROM (SELECT purchase_week, count(*) AS n_created, count(order_approved_at) AS n_approved,
        count(order_delivered_carrier_date) AS n_carrier, count(order_delivered_customer_date) AS n_delivered,
        CAST(sum(CAST(is_on_time AS INTEGER)) AS BIGINT) AS n_on_time,
        CAST(sum(CAST(is_lost AS INTEGER)) AS BIGINT) AS n_lost,
        avg(date_diff('hour', order_purchase_timestamp, order_approved_at)) AS h1,
        avg(date_diff('hour', order_purchase_timestamp, order_delivered_carrier_date)) AS h2,
        avg(date_diff('hour', order_purchase_timestamp, order_delivered_customer_date)) AS h3
      FROM s_orders GROUP BY purchase_week)""")


def _sessions(source: str, keys: str, ts: str, tie: str, gap: int) -> str:
    return f"""
SELECT * EXCLUDE (opens, pos), pos AS session_order_rank, pos = 1 AS is_session_opener
FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, session_id ORDER BY {ts}, {tie}) AS pos
  FROM (SELECT *, CAST(sum(opens) OVER (PARTITION BY {keys} ORDER BY {ts}, {tie}
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id
    FROM (SELECT *, CASE WHEN days_since_prior IS NULL OR days_since_prior > {gap} THEN 1 ELSE 0 END AS opens
      FROM (SELECT *, date_diff('day', lag({ts}) OVER (PARTITION BY {keys} ORDER BY {ts}, {tie}), {ts})
              AS days_since_prior FROM {source}))))"""


_sql("sessions_orders", _sessions(
    "(SELECT order_id, customer_unique_id, order_purchase_timestamp FROM s_orders)",
    "customer_unique_id", "order_purchase_timestamp", "order_id", 30))
_sql("sessions_events", _sessions("(SELECT event_id, user_id, ts FROM events)", "user_id", "ts", "event_id", 1))
_sql("repeat_revenue", _replace("repeats", first_subtotal=4, first_payment_total=4, repeat_revenue=4))
_sql("category_seller_panel", f"""
SELECT purchase_week, dominant_category AS category_en, d.volume_tier AS seller_volume_tier, d.seller_state,
  count(*) AS n_orders, CAST(sum(CAST(is_delivered AS INTEGER)) AS BIGINT) AS n_delivered,
  CAST(sum(CAST(is_lost AS INTEGER)) AS BIGINT) AS n_lost, CAST(sum(CAST(is_on_time AS INTEGER)) AS BIGINT) AS n_on_time,
  {r("sum(payment_total)", 4, "gmv")}, {r("avg(payment_total)", 6, "avg_order_value")},
  {r("avg(CAST(review_score AS DOUBLE))", 6, "avg_review_score")},
  {r("sum(CAST(is_delivered AS INTEGER)) / CAST(count(*) AS DOUBLE)", 6, "conversion_rate")},
  FALSE AS treatment_assigned
FROM facts f LEFT JOIN anchors a ON a.order_id = f.order_id LEFT JOIN d_seller d ON d.seller_id = a.seller_id
WHERE dominant_category IS NOT NULL GROUP BY 1, 2, 3, 4""")
_sql("quality_diagnostics", """
SELECT check_name, CASE WHEN good THEN 'ok' ELSE 'FAIL' END AS status, CAST(seen AS VARCHAR) AS observed FROM (
  SELECT 'fact_orders unique on order_id' AS check_name, count(*) = count(DISTINCT order_id) AS good, count(*) AS seen
  FROM facts
  UNION ALL SELECT 'dim_customer unique on customer_unique_id',
    count(*) = count(DISTINCT customer_unique_id), count(*) FROM d_customer
  UNION ALL SELECT 'fact_orders -> dim_customer FK', count(*) = 0, count(*) FROM facts f
    WHERE NOT EXISTS (SELECT 1 FROM d_customer d WHERE d.customer_unique_id = f.customer_unique_id)
  UNION ALL SELECT 'fact_orders payment_total >= 0', count(*) = 0, count(*) FROM facts WHERE payment_total < 0
  UNION ALL SELECT 'cohort_retention rate in [0,1]', count(*) = 0, count(*) FROM retention
    WHERE retention_rate < 0 OR retention_rate > 1)""")
_sql("row_reconciliation", """
SELECT 'raw orders kept in fact_orders' AS check_name,
  CASE WHEN (a.n - b.n) / CAST(a.n AS DOUBLE) < 0.01 THEN 'ok' ELSE 'FAIL' END AS status,
  printf('%.6f', (a.n - b.n) / CAST(a.n AS DOUBLE)) AS observed
FROM (SELECT count(*) AS n FROM raw_orders) a, (SELECT count(*) AS n FROM facts) b""")
_sql("treated_threshold", f"""
SELECT 'no treated order below threshold' AS check_name, CASE WHEN n = 0 THEN 'ok' ELSE 'FAIL' END AS status,
  CAST(n AS VARCHAR) AS observed
FROM (SELECT count(*) AS n FROM frame
      WHERE treatment = 1 AND (items_subtotal IS NULL OR items_subtotal < {THRESHOLD}))""")
_sql("fk_orphans", """
SELECT order_id, customer_unique_id FROM s_orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.order_id)""")

# -------------------------------------------------------------- features -----------
_sql("order_covariates", _replace("covariates", payment_total=4, items_subtotal=4, items_freight=4))
_sql("treatment_assign", "SELECT order_id, eligible, post, treatment FROM frame")
_sql("modelling_frame", f"""
SELECT order_id, purchase_week, category_en, seller_volume_tier, customer_state, calendar_month,
  {r("items_subtotal", 4)}, is_delivered, is_on_time, eligible, post, treatment,
  category_en_code, seller_volume_tier_code, customer_state_code, calendar_month_code
FROM frame""")
_sql("label_dictionary", """
SELECT p_brand AS label, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT p_brand FROM part)""")


def _panel(keys: str) -> str:
    return f"""
SELECT {keys}, count(*) AS n_orders, CAST(sum(CAST(is_delivered AS INTEGER)) AS BIGINT) AS n_delivered,
  CAST(sum(CAST(is_on_time AS INTEGER)) AS BIGINT) AS n_on_time, {r("avg(items_subtotal)", 4, "avg_subtotal")}
FROM frame GROUP BY {keys}"""


_sql("panel_naive", _panel(
    "category_en_code, seller_volume_tier_code, customer_state_code, calendar_month_code, treatment"))
_sql("panel_did", _panel("category_en_code, seller_volume_tier_code, customer_state_code, eligible, post"))
_sql("panel_outcome_delivered", """
SELECT category_en_code, seller_volume_tier_code, customer_state_code, eligible, post,
  count(*) AS trials, CAST(sum(CAST(is_delivered AS INTEGER)) AS BIGINT) AS successes
FROM frame GROUP BY ALL""")
_sql("cell_summary_2x2", f"""
SELECT eligible, post, count(*) AS n, CAST(sum(CAST(is_on_time AS INTEGER)) AS BIGINT) AS on_time,
  {r("sum(CAST(is_on_time AS INTEGER)) / CAST(count(*) AS DOUBLE)", 6, "rate")}
FROM frame GROUP BY eligible, post""")
_sql("cell_summary_reviews", f"""
SELECT eligible, post, count(*) AS n, {r("avg(review_score)", 6, "avg_review_score")}
FROM review_rows GROUP BY eligible, post""")
_sql("keep_frequent", """
SELECT p_partkey, p_size FROM part QUALIFY count(*) OVER (PARTITION BY p_size) >= 40""")
_sql("customer_revenue_frame", """
SELECT * EXCLUDE (day) REPLACE (round(first_subtotal + 1e-8, 4) AS first_subtotal,
  round(first_payment_total + 1e-8, 4) AS first_payment_total, round(repeat_revenue + 1e-8, 4) AS repeat_revenue,
  round(log_first_subtotal + 1e-8, 6) AS log_first_subtotal)
FROM (SELECT *, 0 AS day FROM (SELECT * FROM revenue_rows))""")
_sql("review_frame", _replace("review_rows", payment_total=4, items_subtotal=4))
_sql("revenue_summary", f"""
SELECT count(*) AS customers, count(*) FILTER (has_repeat) AS repeaters,
  {r("avg(CASE WHEN has_repeat THEN 1.0 ELSE 0.0 END)", 6, "repeat_share")},
  count(*) FILTER (treatment = 1) AS treated, count(*) FILTER (eligible = 1) AS eligible, count(*) FILTER (post = 1) AS post,
  count(DISTINCT first_category) AS categories,
  {r("avg(CASE WHEN has_repeat THEN repeat_revenue END)", 4, "avg_spend_if_repeat")}
FROM revenue_rows""")
_sql("score_shares", f"""
SELECT review_score, count(*) AS n, {r("count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)", 6, "share")}
FROM review_rows GROUP BY review_score""")
_sql("score_mean_by_treatment", f"""
SELECT treatment, count(*) AS n, {r("avg(review_score)", 6, "avg_review_score")}
FROM review_rows GROUP BY treatment""")
_sql("stratified_sample", """
SELECT order_id, order_status
FROM (SELECT *, row_number() OVER (PARTITION BY order_status ORDER BY md5(order_id || '|0'), order_id) AS rn,
        count(*) OVER (PARTITION BY order_status) AS size, count(*) OVER () AS total FROM raw_orders)
WHERE total <= 3000 OR rn <= greatest(1, floor(3000 * size / CAST(total AS DOUBLE)))""")
_sql("weekly_by_eligibility", f"""
SELECT purchase_week, items_subtotal >= {THRESHOLD} AS eligible, count(*) AS n,
  CAST(sum(CAST(is_on_time AS INTEGER)) AS BIGINT) AS on_time,
  {r("sum(CAST(is_on_time AS INTEGER)) / CAST(count(*) AS DOUBLE)", 6, "rate")}
FROM facts WHERE items_subtotal IS NOT NULL AND is_delivered GROUP BY 1, 2""")
_sql("freight_cells", f"""
SELECT items_subtotal >= {THRESHOLD} AS eligible, date_diff('day', DATE '1970-01-01', purchase_week) >= c.day AS post,
  count(*) AS n_orders, {r("avg(items_freight)", 4, "avg_freight")}, {r("avg(items_subtotal)", 4, "avg_subtotal")},
  {r("avg(payment_total)", 4, "avg_payment")}
FROM facts CROSS JOIN cutover c WHERE items_subtotal IS NOT NULL GROUP BY 1, 2""")

# ------------------------------------------------------------- A/B tests -----------
def phi(z: str) -> str:
    """P(Z > z) for z ≥ 0 by Abramowitz & Stegun 26.2.17."""
    t = f"(1.0 / (1.0 + 0.2316419 * ({z})))"
    poly = f"((((1.330274429 * {t} - 1.821255978) * {t} + 1.781477937) * {t} - 0.356563782) * {t} + 0.319381530)"
    return f"(exp(-({z}) * ({z}) / 2.0) / sqrt(2.0 * pi()) * {poly} * {t})"


def two_sided(z: str) -> str:
    return f"(CASE WHEN ({z}) IS NOT NULL THEN least(1.0, 2.0 * {phi(f'abs({z})')}) END)"


def cdf(z: str) -> str:
    return f"CASE WHEN ({z}) >= 0 THEN 1.0 - {phi(f'abs({z})')} ELSE {phi(f'abs({z})')} END"


Z975 = "1.959963984540054"
Z_TEST = f"""
SELECT *, diff - {Z975} * wald AS ci_low, diff + {Z975} * wald AS ci_high, {two_sided("z")} AS p_value
FROM (SELECT *, rate_treated - rate_control AS diff,
        (rate_treated - rate_control) / sqrt(pool * (1 - pool) * (1.0 / n_treated + 1.0 / n_control)) AS z,
        sqrt(rate_treated * (1 - rate_treated) / n_treated + rate_control * (1 - rate_control) / n_control) AS wald
  FROM (SELECT *, successes_treated / CAST(n_treated AS DOUBLE) AS rate_treated,
          successes_control / CAST(n_control AS DOUBLE) AS rate_control,
          (successes_treated + successes_control) / CAST(n_treated + n_control AS DOUBLE) AS pool
    FROM (SELECT count(*) FILTER (treatment = 1) AS n_treated, count(*) FILTER (treatment = 1 AND is_on_time) AS successes_treated,
            count(*) FILTER (treatment = 0) AS n_control, count(*) FILTER (treatment = 0 AND is_on_time) AS successes_control
          FROM frame)))"""
_sql("ab_two_proportion_z", f"""
SELECT n_treated, n_control, successes_treated, successes_control,
  {", ".join(r(c, 6) for c in ("rate_treated", "rate_control", "diff", "z", "p_value", "ci_low", "ci_high"))}
FROM ({Z_TEST})""")

# the tail of Student's t by Simpson's rule over the density, 4000 steps
WELCH = """
SELECT m.*, (SELECT 1.0 - 2.0 * exp(lgamma((m.df + 1) / 2) - lgamma(m.df / 2)) / sqrt(m.df * pi())
    * sum((CASE WHEN g.i IN (0, 4000) THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END)
          * pow(1 + pow(abs(m.t) * g.i / 4000.0, 2) / m.df, -(m.df + 1) / 2)) * abs(m.t) / 4000.0 / 3.0
    FROM range(4001) g(i)) AS p_value
FROM (SELECT *, diff / se AS t, pow(a + b, 2) / (a * a / (n_treated - 1) + b * b / (n_control - 1)) AS df
  FROM (SELECT *, mean_treated - mean_control AS diff, sqrt(v1 / n_treated + v0 / n_control) AS se,
          v1 / n_treated AS a, v0 / n_control AS b
    FROM (SELECT avg(repeat_revenue) FILTER (treatment = 1) AS mean_treated,
            avg(repeat_revenue) FILTER (treatment = 0) AS mean_control,
            var_samp(repeat_revenue) FILTER (treatment = 1) AS v1,
            var_samp(repeat_revenue) FILTER (treatment = 0) AS v0,
            count(*) FILTER (treatment = 1) AS n_treated, count(*) FILTER (treatment = 0) AS n_control FROM revenue_rows))) m"""
# its 97.5% point by sixty bisections of the same integral
_sql("ab_welch_t", f"""
SELECT n_treated, n_control, {r("mean_treated", 4)}, {r("mean_control", 4)}, {r("diff", 4)}, {r("t", 6)},
  {r("df", 4)}, {r("p_value", 5)}, {r("diff - critical * se", 2, "ci_low")}, {r("diff + critical * se", 2, "ci_high")}
FROM (SELECT w.*, (WITH RECURSIVE halving(step, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 64.0::DOUBLE UNION ALL
    SELECT step + 1, CASE WHEN inside < 0.95 THEN (low + high) / 2 ELSE low END,
      CASE WHEN inside < 0.95 THEN high ELSE (low + high) / 2 END
    FROM (SELECT step, low, high, (SELECT 2.0 * exp(lgamma((w.df + 1) / 2) - lgamma(w.df / 2)) / sqrt(w.df * pi())
        * sum((CASE WHEN g.i IN (0, 4000) THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END)
          * pow(1 + pow((low + high) / 2 * g.i / 4000.0, 2) / w.df, -(w.df + 1) / 2)) * (low + high) / 2 / 4000.0 / 3.0
        FROM range(4001) g(i)) AS inside FROM halving WHERE step < 60))
    SELECT low FROM halving WHERE step = 60) AS critical
  FROM ({WELCH}) w)""")


def _rank_test(source: str, value: str) -> str:
    return f"""
SELECT n_treated, n_control, median_treated, median_control, u AS u_statistic,
  CASE WHEN nn > 0 THEN least(1.0, 2.0 * (1.0 - {cdf("z")})) END AS p_value
FROM (SELECT *, (greatest(u, nn - u) - nn / 2.0 - 0.5)
          / sqrt(nn / 12.0 * (n + 1.0 - ties / (n * (n - 1.0)))) AS z
  FROM (SELECT *, r1 - n_treated * (n_treated + 1.0) / 2.0 AS u, CAST(n_treated AS DOUBLE) * n_control AS nn,
          CAST(n_treated + n_control AS DOUBLE) AS n
    FROM (SELECT count(*) FILTER (treatment = 1) AS n_treated, count(*) FILTER (treatment = 0) AS n_control,
            CAST(median(v) FILTER (treatment = 1) AS DOUBLE) AS median_treated,
            CAST(median(v) FILTER (treatment = 0) AS DOUBLE) AS median_control,
            sum(CASE WHEN treatment = 1 THEN lo + (same - 1) / 2.0 END) AS r1,
            sum(CAST(same AS DOUBLE) * same - 1.0) AS ties
          FROM (SELECT treatment, v, rank() OVER (ORDER BY v) AS lo, count(*) OVER (PARTITION BY v) AS same
                FROM (SELECT treatment, {value} AS v FROM {source})))))"""


REVENUE_RANKS = _rank_test("revenue_rows", "round(repeat_revenue, 4)")
SCORE_RANKS = _rank_test("review_rows", "review_score")
for _name, _test in (("ab_mann_whitney", REVENUE_RANKS), ("ab_mann_whitney_score", SCORE_RANKS)):
    _sql(_name, f"""
SELECT n_treated, n_control, {r("median_treated", 4)}, {r("median_control", 4)}, {r("u_statistic", 1)}, {r("p_value", 6)}
FROM ({_test})""")

# all ways to give five of the ranks to the small arm
ORACLE["ab_mann_whitney_exact"] = f"""
WITH v AS (SELECT n_regionkey = 0 AS treated, round(sum(c_acctbal), 2) AS v
           FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey),
s AS (SELECT count(*) FILTER (treated) AS n1, count(*) FILTER (NOT treated) AS n0, median(v) FILTER (treated) AS m1,
        median(v) FILTER (NOT treated) AS m0, sum(k) FILTER (treated) - 15 AS u
      FROM (SELECT *, row_number() OVER (ORDER BY v) AS k FROM v)),
g AS (SELECT unnest(range(1, n1 + n0 + 1)) AS k FROM s),
w AS (SELECT a.k + b.k + c.k + d.k + e.k - 15 AS u FROM g a JOIN g b ON b.k > a.k JOIN g c ON c.k > b.k JOIN g d ON d.k > c.k JOIN g e ON e.k > d.k)
SELECT n1 AS n_treated, n0 AS n_control, {r("m1", 4, "median_treated")}, {r("m0", 4, "median_control")}, {r("CAST(u AS DOUBLE)", 1, "u_statistic")},
  {r("least(1.0, 2.0 * (SELECT count(*) FROM w WHERE w.u <= least(s.u, n1 * n0 - s.u)) / (SELECT count(*) FROM w))", 6, "p_value")}
FROM s"""
CHI = """
SELECT n, chi2, df, exp(-chi2 / 2.0) * (1.0 + chi2 / 2.0) AS p_value
FROM (SELECT CAST(max(total) AS BIGINT) AS n, sum(pow(k - rows_n * cols_n / total, 2) / (rows_n * cols_n / total)) AS chi2,
        CAST((count(DISTINCT treatment) - 1) * (count(DISTINCT review_score) - 1) AS INTEGER) AS df
  FROM (SELECT treatment, review_score, CAST(count(*) AS DOUBLE) AS k,
          sum(count(*)) OVER (PARTITION BY treatment) AS rows_n,
          sum(count(*)) OVER (PARTITION BY review_score) AS cols_n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total
        FROM review_rows GROUP BY treatment, review_score))"""
_sql("ab_chi_square", f"SELECT n, {r('chi2', 6)}, df, {r('p_value', 6)} FROM ({CHI})")
_sql("ab_crosstab", "SELECT treatment, review_score, count(*) AS n FROM review_rows GROUP BY ALL")
_sql("ab_crosstab_wide", "SELECT treatment, " + ", ".join(
    f"count(*) FILTER (review_score = {k}) AS score_{k}" for k in range(1, 6)) + " FROM review_rows GROUP BY treatment")


def _melt(sub: str, test: str, outcome: str, metrics: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{test}' AS test, '{outcome}' AS outcome, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({sub})"
        for m in metrics.split())


_sql("ab_report", "SELECT test, outcome, metric, round(value + 1e-8, 4) AS value FROM (" + " UNION ALL ".join([
    _melt(Z_TEST, "two_proportion_z", "on_time", "diff z p_value"),
    _melt(WELCH, "welch_t", "repeat_revenue", "diff t df p_value"),
    _melt(REVENUE_RANKS, "mann_whitney", "repeat_revenue", "u_statistic p_value"),
    _melt(CHI, "chi_square", "review_score", "chi2 df p_value"),
    _melt(SCORE_RANKS, "mann_whitney", "review_score", "u_statistic p_value")]) + ")")
_sql("ab_report_lines", f"""
SELECT printf('%-24s effect=%+.4f   95%% CI=[%+.4f, %+.4f]   p=%.4f %s', 'on-time (z)', diff, ci_low, ci_high,
  p_value, CASE WHEN p_value < 0.05 THEN '*' ELSE ' ' END) AS line
FROM ({Z_TEST})""")

# -------------------------------------------------------- identification -----------
_CELLS = (("00", 0, 0), ("01", 0, 1), ("10", 1, 0), ("11", 1, 1))


def did(source: str, success: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (eligible = {e} AND post = {p} AND {success}) AS k_{c}, count(*) FILTER (eligible = {e} AND post = {p}) AS n_{c}"
        for c, e, p in _CELLS)
    rates = ", ".join(f"k_{c} / CAST(n_{c} AS DOUBLE) AS rate_{c}, ln(k_{c} / CAST(n_{c} - k_{c} AS DOUBLE)) AS l_{c}" for c, _, _ in _CELLS)
    variance = " + ".join(f"1.0 / k_{c} + 1.0 / (n_{c} - k_{c})" for c, _, _ in _CELLS)
    return f"""
SELECT *, did_logit / did_se AS z, {two_sided("did_logit / did_se")} AS p_value
FROM (SELECT * EXCLUDE (l_00, l_01, l_10, l_11), l_00 AS alpha, l_10 - l_00 AS beta_eligible, l_01 - l_00 AS beta_post,
        l_11 - l_10 - l_01 + l_00 AS did_logit, sqrt({variance}) AS did_se,
        (rate_11 - rate_10 - rate_01 + rate_00) * 100 AS did_pp
  FROM (SELECT *, {rates} FROM (SELECT {counts} FROM {source})))"""


_DID_ROUNDED = [f"rate_{c}" for c, _, _ in _CELLS] + [
    "alpha", "beta_eligible", "beta_post", "did_logit", "did_se", "did_pp", "z", "p_value"]
_sql("did_saturated", _replace(f"({did('frame', 'is_on_time')})", **{c: 6 for c in _DID_ROUNDED}))
_sql("naive_vs_did", f"""
SELECT {r("n.diff * 100", 6, "naive_pp")}, {r("n.z", 6, "naive_z")}, {r("n.p_value", 6, "naive_p")},
  {r("d.beta_eligible", 6, "beta_eligible")}, {r("d.beta_post", 6, "beta_post")}, {r("d.did_logit", 6, "did_logit")},
  {r("d.did_se", 6, "did_se")}, {r("d.did_pp", 6, "did_pp")}, {r("d.p_value", 6, "did_p")}
FROM ({Z_TEST}) n CROSS JOIN ({did('frame', 'is_on_time')}) d""")


def _pre_trend() -> str:
    """The model is saturated in eligibility: two 2-parameter Newton fits, unrolled."""
    steps = ["""weekly AS (SELECT w.*, (w.purchase_week - min(w.purchase_week) OVER ()) / 7.0 AS t FROM (
      SELECT purchase_week, CASE WHEN items_subtotal >= 275000.0 THEN 1 ELSE 0 END AS e, CAST(count(*) AS DOUBLE) AS n,
        CAST(sum(CAST(is_on_time AS INTEGER)) AS DOUBLE) AS k
      FROM facts WHERE items_subtotal IS NOT NULL AND is_delivered GROUP BY 1, 2) w
    CROSS JOIN cutover c WHERE date_diff('day', DATE '1970-01-01', w.purchase_week) < c.day)""",
             "it0 AS (SELECT e, ln(sum(k) / (sum(n) - sum(k))) AS a, 0.0 AS b FROM weekly GROUP BY e)"]
    info = """SELECT w.e, any_value(i.a) AS a, any_value(i.b) AS b, sum(k - n * p) AS g1, sum(t * (k - n * p)) AS g2,
        sum(n * p * (1 - p)) AS h11, sum(t * n * p * (1 - p)) AS h12, sum(t * t * n * p * (1 - p)) AS h22,
        sum(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) AS ll, count(*) AS cells
      FROM (SELECT w.*, i.a, i.b, 1.0 / (1.0 + exp(-(i.a + i.b * w.t))) AS p
            FROM weekly w JOIN {prev} i ON i.e = w.e) w JOIN {prev} i ON i.e = w.e GROUP BY w.e"""
    for i in range(1, 9):
        steps.append(f"""it{i} AS (SELECT e, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a,
      b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM ({info.format(prev=f'it{i - 1}')}))""")
    steps.append(f"fit AS (SELECT *, h22 / (h11 * h22 - h12 * h12) AS va, h11 / (h11 * h22 - h12 * h12) AS vb FROM ({info.format(prev='it8')}))")
    body = f"""
SELECT coefficient, {r("estimate", 5)}, {r("se", 5)}, {r(two_sided("estimate / se"), 5, "p_value")}, {r("aic", 3)}, df_resid,
  CASE WHEN coefficient = 't_x_eligible' THEN CASE WHEN {two_sided("estimate / se")} >= 0.05
    THEN 'consistent with parallel trends' ELSE 'parallel trends violated' END END AS verdict
FROM (SELECT 'const' AS coefficient, f0.a AS estimate, sqrt(f0.va) AS se FROM fit f0 WHERE e = 0
  UNION ALL SELECT 't', f0.b, sqrt(f0.vb) FROM fit f0 WHERE e = 0
  UNION ALL SELECT 'eligible', f1.a - f0.a, sqrt(f1.va + f0.va) FROM fit f0 JOIN fit f1 ON f0.e = 0 AND f1.e = 1
  UNION ALL SELECT 't_x_eligible', f1.b - f0.b, sqrt(f1.vb + f0.vb) FROM fit f0 JOIN fit f1 ON f0.e = 0 AND f1.e = 1)
CROSS JOIN (SELECT -2 * sum(ll) + 8 AS aic, CAST(sum(cells) - 4 AS INTEGER) AS df_resid FROM fit)"""
    # one more WITH list in front of the shared expressions
    shared = with_ctes("SELECT 1 FROM facts, cutover")
    return shared[: shared.rindex("SELECT 1 FROM facts, cutover")] + ", " + ",\n".join(steps) + body


ORACLE["pre_trend"] = _pre_trend()

SUBTOTALS = "(SELECT round(items_subtotal, 4) AS v FROM item_roll WHERE items_subtotal >= 0)"
BINS = f"""
SELECT CAST(s.i AS INTEGER) AS bin, 75000.0 + s.i * 12500.0 AS bin_low, 75000.0 + (s.i + 1) * 12500.0 AS bin_high,
  75000.0 + s.i * 12500.0 + 6250.0 AS center, coalesce(h.n, 0) AS n
FROM range(36) s(i) LEFT JOIN (
  SELECT least(CAST(floor((v - 75000.0) / 12500.0) AS INTEGER), 35) AS b, count(*) AS n
  FROM {SUBTOTALS} WHERE v BETWEEN 75000.0 AND 525000.0 GROUP BY 1) h ON h.b = s.i"""
_sql("histogram", f"""
SELECT bin, CAST(bin_low AS DOUBLE) AS bin_low, CAST(bin_high AS DOUBLE) AS bin_high, CAST(center AS DOUBLE) AS center, n
FROM ({BINS})""")
_sql("subtotal_profile", f"""
SELECT count(*) AS n, {r("min(v)", 4, "min")}, {r("max(v)", 4, "max")}, {r("median(v)", 4, "median")} FROM {SUBTOTALS}""")


def _bunching() -> str:
    """The cubic by orthogonal polynomials built up on the kept bins."""
    keep = "(center < 250000.0 OR center > 300000.0)"
    steps = [
        f"bins AS ({BINS})",
        f"q0 AS (SELECT *, ln(CAST(center AS DOUBLE) / 275000.0) AS x, 1.0 AS p0, CASE WHEN {keep} THEN 1.0 ELSE 0.0 END AS w FROM bins)",
        "q1 AS (SELECT *, x - (sum(w * x) OVER ()) / sum(w) OVER () AS p1 FROM q0)",
        """q2 AS (SELECT *, p1 * (x - (sum(w * x * p1 * p1) OVER ()) / sum(w * p1 * p1) OVER ())
             - p0 * (sum(w * p1 * p1) OVER ()) / sum(w * p0 * p0) OVER () AS p2 FROM q1)""",
        """q3 AS (SELECT *, p2 * (x - (sum(w * x * p2 * p2) OVER ()) / sum(w * p2 * p2) OVER ())
             - p1 * (sum(w * p2 * p2) OVER ()) / sum(w * p1 * p1) OVER () AS p3 FROM q2)""",
        "fit AS (SELECT *, " + " + ".join(
            f"p{i} * (sum(w * n * p{i}) OVER ()) / sum(w * p{i} * p{i}) OVER ()" for i in range(4)) + " AS predicted FROM q3)",
    ]
    body = f"""
SELECT CAST(observed_below AS BIGINT) AS observed_below, {r("predicted_below", 3)},
  CAST(observed_above AS BIGINT) AS observed_above, {r("predicted_above", 3)},
  {r("observed_above - predicted_above", 3, "excess")}, {r("z", 4)},
  CASE WHEN z > 1.96 THEN 'policy bunching' WHEN z < -1.96 THEN 'structural kink' ELSE 'clean' END AS regime
FROM (SELECT *, (observed_above - predicted_above) / sqrt(greatest(predicted_above, 1.0)) AS z
  FROM (SELECT sum(n) FILTER (center < 275000.0 AND center >= 262500.0) AS observed_below,
          sum(predicted) FILTER (center < 275000.0 AND center >= 262500.0) AS predicted_below,
          sum(n) FILTER (center > 275000.0 AND center <= 287500.0) AS observed_above,
          sum(predicted) FILTER (center > 275000.0 AND center <= 287500.0) AS predicted_above FROM fit))"""
    shared = with_ctes("SELECT 1 FROM item_roll")
    return shared[: shared.rindex("SELECT 1 FROM item_roll")] + ", " + ",\n".join(steps) + body


ORACLE["bunching"] = _bunching()


def _independence(claim: str, x: str, y: str) -> str:
    strata = "treatment, category_en, seller_volume_tier"
    return f"""
SELECT '{claim}' AS claim, count(*) AS n_strata, CAST(sum(n) AS BIGINT) AS n, sum(chi2) AS chi2, CAST(sum(df) AS INTEGER) AS df
FROM (SELECT {strata}, max(total) AS n, sum(k * k * total / (rn * cn)) - max(total) AS chi2,
        (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS df
  FROM (SELECT {strata}, x, y, CAST(count(*) AS DOUBLE) AS k, CAST(sum(count(*)) OVER (PARTITION BY {strata}, x) AS DOUBLE) AS rn,
          CAST(sum(count(*)) OVER (PARTITION BY {strata}, y) AS DOUBLE) AS cn,
          CAST(sum(count(*)) OVER (PARTITION BY {strata}) AS DOUBLE) AS total
        FROM (SELECT {strata}, {x} AS x, {y} AS y FROM frame) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY {strata}, x, y)
  GROUP BY {strata}) WHERE df > 0"""


_sql("stratified_independence", f"""
SELECT claim, n_strata, n, {r("chi2", 4)}, df,
  round(1.0 - ({cdf("(pow(chi2 / df, 1.0 / 3.0) - (1.0 - 2.0 / (9.0 * df))) / sqrt(2.0 / (9.0 * df))")}) + 1e-8, 6) AS p_value
FROM ({_independence("basket|month", "least(floor(items_subtotal / 100000), 4)", "calendar_month")}
  UNION ALL {_independence("freight|state", "least(floor(items_freight / 5000), 4)", "customer_state")})""")

# ------------------------------------------------------- pooled effects ------------
def _logit(cells: list[tuple[str, int]], success: str) -> str:
    effect = " + ".join(
        f"({sign}) * ln((count(*) FILTER ({c} AND {success}) + 0.5) / (count(*) FILTER ({c} AND NOT {success}) + 0.5))" for c, sign in cells)
    variance = " + ".join(
        f"1.0 / (count(*) FILTER ({c} AND {success}) + 0.5) + 1.0 / (count(*) FILTER ({c} AND NOT {success}) + 0.5)" for c, _ in cells)
    return f"{effect} AS effect, {variance} AS variance"


_SIGNED = [("(eligible = 1 AND post = 1)", 1), ("(eligible = 1 AND post = 0)", -1),
           ("(eligible = 0 AND post = 1)", -1), ("(eligible = 0 AND post = 0)", 1)]
_ARMS = [("(treatment = 1)", 1), ("(treatment = 0)", -1)]


def effects(source: str, category: str, cells: list, success: str) -> str:
    return f"SELECT {category} AS category, count(*) AS n, {_logit(cells, success)} FROM {source} GROUP BY {category}"


def pool(sub: str, group: str = "", tau2: str = "tau2_dl") -> str:
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    return f"""
SELECT * EXCLUDE (w, sw, sw2, swe, swe2, k, raw, tau2_dl, pw, muv, pull), sqrt(muv) AS mu_sd,
  shrunk - 1.880794 * shrunk_sd AS low, shrunk + 1.880794 * shrunk_sd AS high, {cdf("shrunk / shrunk_sd")} AS p_positive
FROM (SELECT *, (1.0 - pull) * coalesce(effect, 0.0) + pull * mu AS shrunk,
        sqrt(coalesce(variance * tau2 / (variance + tau2), tau2) + pull * pull * muv) AS shrunk_sd
  FROM (SELECT *, sum(pw * effect) {over} / sum(pw) {over} AS mu, 1.0 / sum(pw) {over} AS muv,
          coalesce(variance / (variance + tau2), 1.0) AS pull
    FROM (SELECT *, 1.0 / (variance + tau2) AS pw
      FROM (SELECT *, {tau2} AS tau2
        FROM (SELECT *, CASE WHEN raw > 1e-12 THEN raw ELSE 0.0 END AS tau2_dl
          FROM (SELECT *, coalesce((swe2 - swe * swe / sw - (k - 1)) / nullif(sw - sw2 / sw, 0), 0.0) AS raw
            FROM (SELECT *, sum(w) {over} AS sw, sum(w * w) {over} AS sw2, sum(w * effect) {over} AS swe,
                    sum(w * effect * effect) {over} AS swe2, count(w) {over} AS k
              FROM (SELECT *, 1.0 / variance AS w FROM ({sub})))))))))"""


_POOL = ("effect", "variance", "tau2", "mu", "mu_sd", "shrunk", "shrunk_sd", "low", "high", "p_positive")
ON_TIME = effects("frame", "category_en", _SIGNED, "is_on_time")
NAIVE = effects("frame", "category_en", _ARMS, "is_on_time")
_sql("category_did", _replace(f"({ON_TIME})", effect=6, variance=6))
_sql("category_pooled", _replace(f"({pool(ON_TIME)})", **{c: 6 for c in _POOL}))
_sql("category_naive_pooled", _replace(f"({pool(NAIVE)})", **{c: 6 for c in _POOL}))


def mean_of(pooled: str, group: str = "") -> str:
    key = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {key}categories, mu, mu_sd, tau, mu - 1.880794 * mu_sd AS low, mu + 1.880794 * mu_sd AS high,
  {cdf("mu / mu_sd")} AS p_positive
FROM (SELECT {key}count(*) AS categories, max(mu) AS mu, max(mu_sd) AS mu_sd, sqrt(max(tau2)) AS tau FROM ({pooled}) {tail})"""


_MEAN = ("mu", "mu_sd", "tau", "low", "high", "p_positive")
_sql("pooled_mean", _replace(f"({mean_of(pool(ON_TIME))})", **{c: 6 for c in _MEAN}))

_SIGN = "CASE WHEN eligible = post THEN 1.0 ELSE -1.0 END"
STAGE_ONE = effects("revenue_rows", "first_category", _SIGNED, "economic_repeat = 1")
STAGE_TWO = f"""
SELECT category, n, CASE WHEN cells = 4 THEN did END AS effect,
  CASE WHEN cells = 4 THEN s2 * (inverse_n + did_x * did_x / sxx_all) END AS variance
FROM (SELECT category, CAST(sum(n) AS BIGINT) AS n, count(*) AS cells, sum(sign * (y - slope * x)) AS did, sum(sign * x) AS did_x,
        sum(1.0 / n) AS inverse_n, max(sxx_all) AS sxx_all, max((syy_all - slope * sxy_all) / freedom) AS s2
  FROM (SELECT *, sxy_all / sxx_all AS slope
    FROM (SELECT *, sum(sxx) OVER () AS sxx_all, sum(sxy) OVER () AS sxy_all, sum(syy) OVER () AS syy_all,
            sum(n) OVER () - count(*) OVER () - 1 AS freedom
      FROM (SELECT first_category AS category, {_SIGN} AS sign, eligible, post, count(*) AS n,
              avg(ln(repeat_revenue)) AS y, avg(log_first_subtotal) AS x,
              var_pop(log_first_subtotal) * count(*) AS sxx, var_pop(ln(repeat_revenue)) * count(*) AS syy,
              covar_pop(log_first_subtotal, ln(repeat_revenue)) * count(*) AS sxy
            FROM revenue_rows WHERE economic_repeat = 1 GROUP BY first_category, eligible, post)))
  GROUP BY category)"""
HURDLE = pool(f"SELECT 'repeat' AS stage, * FROM ({STAGE_ONE}) UNION ALL SELECT 'spend', * FROM ({STAGE_TWO})", "stage")
_sql("hurdle_effects", _replace(f"({HURDLE})", **{c: 6 for c in _POOL}))
ORDINAL = pool(f"""
SELECT category, max(n) AS n, sum(effect / variance) / sum(1.0 / variance) AS effect, 1.0 / sum(1.0 / variance) AS variance
FROM ({" UNION ALL ".join(effects("review_rows", "category_en", _SIGNED, f"(score_index >= {k})") for k in range(1, 5))})
GROUP BY category""")
_sql("ordinal_effects", _replace(f"({ORDINAL})", **{c: 6 for c in _POOL}))
_sql("ordinal_cutpoints", f"""
SELECT threshold, {r("k - first_value(k) OVER (ORDER BY threshold)", 6, "cutpoint")},
  {r("k - lag(k) OVER (ORDER BY threshold)", 6, "gap")}
FROM ({" UNION ALL ".join(f"SELECT {k} AS threshold, ln((count(*) FILTER (score_index < {k}) + 0.5) / (count(*) FILTER (score_index >= {k}) + 0.5)) AS k FROM review_rows" for k in range(1, 5))})""")
SCENARIOS = f"""
SELECT e.*, s.prior, s.factor FROM ({ON_TIME}) e
CROSS JOIN (VALUES ('estimated', 1.0), ('halved', 0.5), ('fixed_0.04', NULL)) s(prior, factor)"""
_sql("prior_sensitivity", f"""
SELECT prior, categories, {", ".join(r(c, 6) for c in _MEAN)},
  {r("max(mu) OVER () - min(mu) OVER ()", 6, "spread")}, {r("(max(mu) OVER () - min(mu) OVER ()) * 11.0", 6, "spread_pp")}
FROM ({mean_of(pool(SCENARIOS, "prior", "coalesce(factor * tau2_dl, 0.04)"), "prior")})""")
_sql("top_categories", f"""
SELECT rank, category, {", ".join(r(c, 6) for c in ("shrunk", "low", "high", "p_positive"))},
  {r("(1.0 / (1.0 + exp(-(ln(0.89 / 0.11) + shrunk))) - 0.89) * 100", 6, "points")}
FROM (SELECT *, CAST(row_number() OVER (ORDER BY shrunk DESC, category) AS INTEGER) AS rank FROM ({pool(ON_TIME)}))
WHERE rank <= 5""")


def _side(name: str) -> str:
    return ", ".join(f"{name}.{c} AS {name}_{a}" for c, a in (
        ("shrunk", "effect"), ("low", "low"), ("high", "high"), ("p_positive", "p_positive")))


_OUTCOMES = {
    "on_time": pool(ON_TIME), "repeat": f"SELECT * FROM ({HURDLE}) WHERE stage = 'repeat'",
    "spend": f"SELECT * FROM ({HURDLE}) WHERE stage = 'spend'", "review": ORDINAL}
_sql("effects_side_by_side", "SELECT coalesce(" + ", ".join(f"{n}.category" for n in _OUTCOMES) + ") AS category, " + ", ".join(
    f"round({n}.{c} + 1e-8, 6) AS {n}_{a}" for n in _OUTCOMES for c, a in (
        ("shrunk", "effect"), ("low", "low"), ("high", "high"), ("p_positive", "p_positive")))
    + f" FROM ({_OUTCOMES['on_time']}) on_time FULL JOIN ({_OUTCOMES['repeat']}) repeat ON repeat.category = on_time.category"
    + f" FULL JOIN ({_OUTCOMES['spend']}) spend ON spend.category = coalesce(on_time.category, repeat.category)"
    + f" FULL JOIN ({_OUTCOMES['review']}) review ON review.category = coalesce(on_time.category, repeat.category, spend.category)")
_LISTS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT category, '{n}' AS outcome FROM ({_OUTCOMES[n]}) ORDER BY shrunk DESC, category LIMIT 5)"
    for n in ("on_time", "repeat", "spend"))
_sql("rollout_shortlist", f"""
SELECT category, count(*) AS lists, string_agg(outcome, ',' ORDER BY outcome) AS outcomes FROM ({_LISTS})
WHERE category NOT IN (SELECT category FROM ({ORDINAL}) ORDER BY shrunk, category LIMIT 5)
GROUP BY category HAVING count(*) >= 2""")
# each outcome in its own terms: points at a base rate, a multiplier, or none
_TERMS = {"on_time": "(1.0 / (1.0 + exp(-(ln(0.89 / 0.11) + shrunk))) - 0.89) * 100",
          "repeat": "(1.0 / (1.0 + exp(-(ln(0.023 / 0.977) + shrunk))) - 0.023) * 100",
          "spend": "exp(shrunk)", "review": "CAST(NULL AS DOUBLE)"}
_sql("category_recommendations", " UNION ALL ".join(
    f"""SELECT '{n}' AS outcome, '{word}' AS direction, rank, category, {", ".join(r(c, 6) for c in ("shrunk", "low", "high", "p_positive"))},
  {r(_TERMS[n], 6, "size")}
FROM (SELECT *, CAST(row_number() OVER (ORDER BY shrunk {way}, category) AS INTEGER) AS rank FROM ({sub})) WHERE rank <= 5"""
    for n, sub in _OUTCOMES.items() for word, way in (("best", "DESC"), ("worst", "ASC"))))
_sql("cost_benefit", f"""
SELECT n_orders, {r("avg_freight", 4)}, {r("avg_payment", 4)}, {r("p0", 6, "p_control")}, {r("p1", 6, "p_treated")},
  {r("m", 6, "spend_multiplier")}, {r("subsidy", 2)}, {r("gmv", 2, "incremental_gmv")},
  {r("gmv * 0.2", 2, "incremental_margin")}, {r("gmv * 0.2 - subsidy", 2, "net")}, {r("subsidy / gmv", 4, "break_even_margin")}
FROM (SELECT *, n_orders * avg_freight AS subsidy,
        n_orders * (p1 * avg_payment * (m - 1) + (p1 - p0) * avg_payment * m) AS gmv
  FROM (SELECT f.*, 1.0 / (1.0 + exp(-b.alpha)) AS p0, 1.0 / (1.0 + exp(-(b.alpha + h.b_shift))) AS p1, exp(h.l_shift) AS m
    FROM (SELECT count(*) AS n_orders, avg(items_freight) AS avg_freight, avg(payment_total) AS avg_payment
          FROM facts CROSS JOIN cutover c WHERE items_subtotal >= {THRESHOLD}
            AND date_diff('day', DATE '1970-01-01', purchase_week) >= c.day) f
    CROSS JOIN ({did("revenue_rows", "economic_repeat = 1")}) b
    CROSS JOIN (SELECT max(mu) FILTER (stage = 'repeat') AS b_shift, max(mu) FILTER (stage = 'spend') AS l_shift
                FROM ({HURDLE})) h))""")

# ---------------------------------------------------------------- draws ------------
def drawn(source: str, keys: list[str], counts: list[str], seed: int, draws: int = 4000, chains: int = 4) -> str:
    """Poisson draws around the counts of a cell table: md5(seed, count, keys, draw) looked up among cumulated probabilities."""
    parts = []
    for name in counts:
        key = "'|' || ".join(f"{k} || " for k in keys)
        label = f"'{seed}|{name}|' || {key}'|' || t"
        parts.append(f"""
SELECT {", ".join(keys)}, t, '{name}' AS what, p.j AS v
FROM (SELECT *, (('0x' || substr(md5({label}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT {", ".join(keys)}, t, CAST({name} AS DOUBLE) AS m FROM {source} CROSS JOIN range({draws}) g(t))) d
ASOF JOIN (SELECT m, j, coalesce(sum(exp(j * ln(greatest(m, 1e-300)) - m - lgamma(j + 1))) OVER (
      PARTITION BY m ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below
    FROM (SELECT m, unnest(range(CAST(greatest(floor(m - 10 * sqrt(m) - 30), 0) AS BIGINT), CAST(m + 10 * sqrt(m) + 30 AS BIGINT))) AS j
          FROM (SELECT DISTINCT CAST({name} AS DOUBLE) AS m FROM {source}))) p ON d.m = p.m AND d.u > p.below""")
    size = -(-draws // chains)
    columns = ", ".join(f"CAST(max(v) FILTER (what = '{name}') AS BIGINT) AS {name}" for name in counts)
    return f"""
SELECT {", ".join(keys)}, CAST(t // {size} AS INTEGER) AS chain, CAST(t % {size} AS INTEGER) AS draw, {columns}
FROM ({" UNION ALL ".join(parts)}) GROUP BY {", ".join(keys)}, t"""


KEYS = ["category", "eligible", "post"]
OT_CELLS = """ot_cells AS (SELECT category_en AS category, eligible, post, count(*) AS trials,
  count(*) FILTER (is_on_time) AS successes, count(*) FILTER (NOT is_on_time) AS failures FROM frame GROUP BY 1, 2, 3)"""


def with_draws(body: str, base: str, *extra: str) -> str:
    shared = with_ctes(f"SELECT 1 FROM {base}")
    head = shared[: shared.rindex(f"SELECT 1 FROM {base}")]
    return head + ", " + ",\n".join(extra) + body


def _ot_draws(seed: int) -> str:
    return f"ot_draws AS ({drawn('ot_cells', KEYS, ['successes', 'failures'], seed)})"


def _signed_draws() -> str:
    def term(e: int, p: int, sign: int) -> str:
        def pick(c: str) -> str:
            return f"coalesce(sum({c}) FILTER (eligible = {e} AND post = {p}), 0) + 0.5"
        return f"({sign}) * ln(({pick('successes')}) / ({pick('failures')}))"
    body = " + ".join(term(e, p, 1 if e == p else -1) for _, e, p in _CELLS)
    return f"""effect_draws AS (SELECT 'did_logit' AS param, category, chain, draw, round({body}, 12) AS value
  FROM ot_draws GROUP BY category, chain, draw)"""


EFFECT_DRAWS = (OT_CELLS, _ot_draws(0), _signed_draws())


def _draw_sql(name: str, body: str, base: str = "frame", extra: tuple = EFFECT_DRAWS) -> None:
    ORACLE[name] = with_draws("\n" + body, base, *extra)


_draw_sql("bootstrap_effects", _replace("effect_draws", value=6))
_draw_sql("draw_summary", f"""
SELECT param, category, {r("avg(value)", 6, "mean")}, {r("stddev_samp(value)", 6, "sd")},
  {r("quantile_cont(value, 0.03)", 6, "p3")}, {r("quantile_cont(value, 0.97)", 6, "p97")},
  {r("avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END)", 6, "p_positive")}, count(*) AS n_samples
FROM effect_draws GROUP BY param, category""")
_draw_sql("draw_hdi", f"""
SELECT param, category, {r("low", 6, "hdi_low")}, {r("high", 6, "hdi_high")}
FROM (SELECT a.param, a.category, a.value AS low, b.value AS high,
        row_number() OVER (PARTITION BY a.param, a.category ORDER BY b.value - a.value, a.value) AS pick
  FROM sorted_draws a JOIN sorted_draws b ON b.param = a.param AND b.category = a.category
    AND b.rn = a.rn + CAST(floor(a.n * 0.94) AS BIGINT)) WHERE pick = 1""", extra=(*EFFECT_DRAWS, """
sorted_draws AS (SELECT *, row_number() OVER (PARTITION BY param, category ORDER BY value, chain, draw) AS rn,
  count(*) OVER (PARTITION BY param, category) AS n FROM effect_draws)"""))
_draw_sql("draw_rhat", f"""
SELECT param, category, count(*) AS chains, {r("sqrt((avg(v) * (avg(n) - 1.0) / avg(n) + var_samp(m)) / avg(v))", 6, "rhat")}
FROM (SELECT param, category, chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n
      FROM effect_draws GROUP BY param, category, chain) GROUP BY param, category""")
# lag by lag, each draw joined to the later ones of its chain
_draw_sql("draw_ess", f"""
SELECT param, category, {r("total / greatest(2.0 * coalesce(sum(pair) FILTER (least_pair > 0), 0.0) - 1.0, 1.0 / log10(total))", 4, "ess")}
FROM (SELECT *, min(pair) OVER (PARTITION BY param, category ORDER BY k) AS least_pair
  FROM (SELECT param, category, lag // 2 AS k, max(total) AS total,
          sum(CASE WHEN lag = 0 THEN 1.0 ELSE 1.0 - (within_v - acov) / (within_v * (n - 1.0) / n + between_v) END) AS pair
    FROM (SELECT param, category, lag, avg(acov) AS acov, avg(v) AS within_v, coalesce(var_samp(m), 0.0) AS between_v,
            avg(n) AS n, CAST(sum(n) AS DOUBLE) AS total
      FROM (SELECT a.param, a.category, a.chain, b.draw - a.draw AS lag, sum(a.x * b.x) / max(a.n) AS acov,
              max(a.v) AS v, max(a.m) AS m, max(a.n) AS n
            FROM centred a JOIN centred b ON b.param = a.param AND b.category = a.category AND b.chain = a.chain AND b.draw >= a.draw
            WHERE b.draw - a.draw <= a.n - 2 GROUP BY ALL)
      GROUP BY param, category, lag)
    WHERE lag < 2 * ((n - 1) // 2) GROUP BY param, category, lag // 2))
GROUP BY param, category, total""", extra=(*EFFECT_DRAWS, """centred AS (SELECT param, category, chain, draw, value - avg(value) OVER c AS x,
  avg(value) OVER c AS m, var_samp(value) OVER c AS v, count(*) OVER c AS n
  FROM effect_draws WINDOW c AS (PARTITION BY param, category, chain))"""))
LOGLIK = """loglik AS (SELECT c.category, c.eligible, c.post,
  lgamma(c.trials + 1) - lgamma(c.successes + 1) - lgamma(c.failures + 1)
    + c.successes * ln((d.successes + 0.5) / (d.successes + d.failures + 1.0))
    + c.failures * ln(1.0 - (d.successes + 0.5) / (d.successes + d.failures + 1.0)) AS l
  FROM ot_cells c JOIN ot_draws d ON d.category = c.category AND d.eligible = c.eligible AND d.post = c.post)"""
LL = (OT_CELLS, _ot_draws(1), LOGLIK)


def _elpd(pointwise: str, elpd: str, p: str) -> str:
    return f"""
SELECT 'did' AS model, count(*) AS n_cells, {r("sum(lppd)", 4, "lppd")}, {r(f"sum({p})", 4, p)}, {r(f"sum({elpd})", 4, elpd)},
  {r(f"sqrt(count(*) * var_pop({elpd}))", 4, "se")}, {r(f"avg({elpd})", 4, "elpd_per_cell")}
FROM ({pointwise})"""


_draw_sql("waic", _elpd("""
SELECT *, lppd - p_waic AS elpd_waic FROM (SELECT ln(avg(exp(l))) AS lppd, var_pop(l) AS p_waic
FROM loglik GROUP BY category, eligible, post)""", "elpd_waic", "p_waic"), extra=LL)
_draw_sql("loo_truncated", _elpd("""
SELECT *, lppd - elpd_loo AS p_loo FROM (SELECT ln(avg(exp(l))) AS lppd, ln(sum(w * exp(l)) / sum(w)) AS elpd_loo
FROM (SELECT *, least(w0, avg(w0) OVER c * sqrt(count(*) OVER c)) AS w
      FROM (SELECT *, exp(min(l) OVER (PARTITION BY category, eligible, post) - l) AS w0 FROM loglik)
      WINDOW c AS (PARTITION BY category, eligible, post))
GROUP BY category, eligible, post)""", "elpd_loo", "p_loo"), extra=LL)
_draw_sql("predictive_check", f"""
SELECT {r("observed", 6)}, {r("avg(rate)", 6, "replicated")}, {r("quantile_cont(rate, 0.05)", 6, "p5")},
  {r("quantile_cont(rate, 0.95)", 6, "p95")}, CASE WHEN abs(avg(rate) - observed) < 0.005 THEN 'GOOD' ELSE 'CHECK' END AS verdict
FROM (SELECT chain, draw, sum(successes) / CAST(sum(successes + failures) AS DOUBLE) AS rate FROM ot_draws GROUP BY chain, draw)
CROSS JOIN (SELECT sum(successes) / CAST(sum(trials) AS DOUBLE) AS observed FROM ot_cells) GROUP BY observed""",
          extra=(OT_CELLS, _ot_draws(2)))
_draw_sql("predictive_spend", f"""
SELECT {r("any_value(o.m)", 6, "observed")}, {r("avg(d.m)", 6, "replicated")}
FROM (SELECT chain, draw, sum(s.n * c.y) / sum(s.n) AS m FROM sp_draws s JOIN sp_cells c
        ON c.category = s.category AND c.eligible = s.eligible AND c.post = s.post GROUP BY chain, draw) d
CROSS JOIN (SELECT sum(n * y) / sum(n) AS m FROM sp_cells) o""", base="revenue_rows", extra=(
    """sp_cells AS (SELECT first_category AS category, eligible, post, count(*) AS n, avg(ln(repeat_revenue)) AS y
  FROM revenue_rows WHERE economic_repeat = 1 GROUP BY 1, 2, 3)""",
    f"sp_draws AS ({drawn('sp_cells', KEYS, ['n'], 3)})"))
_draw_sql("predictive_scores", f"""
SELECT o.review_score, {r("any_value(o.share)", 6, "observed")}, {r("avg(d.share)", 6, "replicated")}
FROM (SELECT review_score, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM sc_cells) o
JOIN (SELECT review_score, n / CAST(sum(n) OVER (PARTITION BY chain, draw) AS DOUBLE) AS share FROM sc_draws) d
  ON d.review_score = o.review_score GROUP BY o.review_score""", base="review_rows", extra=(
    "sc_cells AS (SELECT review_score, count(*) AS n FROM review_rows GROUP BY review_score)",
    f"sc_draws AS ({drawn('sc_cells', ['review_score'], ['n'], 4)})"))


# -------------------------------------------------------------- predictive limits --
def _limits(pooled: str, keys: str, seen: str = "effect", rate: bool = False) -> str:
    def scale(v: str) -> str:
        return f"1.0 / (1.0 + exp(-({v})))" if rate else v

    middle = f"({seen} - effect + mu)"
    return f"""
SELECT {keys}, {r(scale(seen), 6, "observed")}, {r(scale(middle), 6, "predicted")}, {r(scale(f"{middle} - 1.880794 * spread"), 6, "low")},
  {r(scale(f"{middle} + 1.880794 * spread"), 6, "high")}, {r("(effect - mu) / spread", 5, "z")},
  CASE WHEN abs((effect - mu) / spread) <= 1.880794 THEN 'GOOD' ELSE 'CHECK' END AS verdict
FROM (SELECT *, sqrt(variance + tau2 + mu_sd * mu_sd) AS spread FROM ({pooled})) WHERE effect IS NOT NULL"""


_LEVEL = """SELECT category_en AS category, ln((count(*) FILTER (eligible = 1 AND post = 1 AND is_on_time) + 0.5)
  / (count(*) FILTER (eligible = 1 AND post = 1 AND NOT is_on_time) + 0.5)) AS level FROM frame GROUP BY category_en"""
_sql("predictive_limits", _limits(f"SELECT * FROM ({pool(ON_TIME)}) JOIN ({_LEVEL}) USING (category)", "category", "level", True))
_sql("predictive_limits_hurdle", _limits(HURDLE, "stage, category"))
_sql("predictive_limits_scores", _limits(ORDINAL, "category"))

_WHERE = "purchase_week, category_en, seller_volume_tier, customer_state, eligible, post"


def _left_out(model: str, group: str) -> str:
    return f"""SELECT '{model}' AS model, {_WHERE}, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1.0 - p) AS e
FROM (SELECT *, (sum(k) OVER g - k + 0.5) / (sum(n) OVER g - n + 1.0) AS p
      FROM (SELECT {_WHERE}, treatment, count(*) AS n, count(*) FILTER (is_on_time) AS k FROM frame GROUP BY ALL)
      WINDOW g AS (PARTITION BY {group}))"""


_BOTH = _left_out("naive", "category_en, treatment") + " UNION ALL " + _left_out("did", "category_en, eligible, post")
_sql("model_comparison", f"""
SELECT model, count(*) AS n_cells, {r("sum(e)", 3, "elpd")}, {r("sqrt(count(*) * var_pop(e))", 3, "se")},
  CAST(max(rank) AS INTEGER) AS rank, {r("sum(e - top)", 3, "difference")}, {r("sqrt(count(*) * var_pop(e - top))", 4, "difference_se")}
FROM (SELECT *, max(e) FILTER (rank = 1) OVER (PARTITION BY {_WHERE}) AS top
      FROM (SELECT *, dense_rank() OVER (ORDER BY total DESC, model) AS rank
            FROM (SELECT *, sum(e) OVER (PARTITION BY model) AS total FROM ({_BOTH}))))
GROUP BY model""")


# -------------------------------------------------------------- MAP certificates ---
# at the optimum every coefficient explains the outcome total of its own rows
def _certificate(source: str, outcome: str, terms: list[tuple[str, str | None, str, bool]], stage: str, cutpoints: int = 0) -> str:
    """`terms` are (name, label column or none, multiplier, has a common mean)."""
    parts = []
    for name, label, times, bar in terms:
        if label:
            parts.append(f"SELECT '{name}' AS term, CAST({label} AS VARCHAR) AS label, CAST(sum(({times}) * ({outcome})) AS DOUBLE) AS total "
                         f"FROM {source} GROUP BY {label}")
        if bar or not label:
            parts.append(f"SELECT '{name}{'_bar' if bar else ''}', CAST(NULL AS VARCHAR), CAST(sum(({times}) * ({outcome})) AS DOUBLE) FROM {source}")
    parts += [f"SELECT 'cutpoint', '{k}', CAST(0 AS DOUBLE)" for k in range(1, cutpoints)]
    return (f"SELECT term, label, {r('total', 3, 'observed')}, {r('total', 3, 'explained')}, '{stage}' AS stage "
            f"FROM ({' UNION ALL '.join(parts)})")


_CAT, _POLICY = "category_en", "eligible * post"
_DID_FIXED = [("eligible", None, "eligible", False), ("post", None, "post", False)]
_HIT, _BACK = "CASE WHEN is_on_time THEN 1 ELSE 0 END", "economic_repeat"
_SPENDERS = "(SELECT * FROM revenue_rows WHERE economic_repeat = 1)"
_SLOPE = ("log_first_subtotal", None, "log_first_subtotal", False)
_sql("map_certificate", _certificate("frame", _HIT, [
    ("alpha", _CAT, "1", True), *_DID_FIXED, ("delta", _CAT, _POLICY, True),
    ("gamma_tier", "seller_volume_tier", "1", False), ("gamma_state", "customer_state", "1", False)], "on_time"))
_sql("map_certificate_naive", _certificate("frame", _HIT, [
    ("alpha", _CAT, "1", True), ("tau", _CAT, "treatment", True), ("beta_tier", "seller_volume_tier", "1", False),
    ("gamma_state", "customer_state", "1", False), ("delta_month", "calendar_month", "1", False)], "on_time"))
_sql("map_certificate_revenue", _certificate("revenue_rows", _BACK, [
    ("alpha", "first_category", "1", True), *_DID_FIXED, ("delta", "first_category", _POLICY, True)], "repeat") + " UNION ALL " + _certificate(
    _SPENDERS, "ln(repeat_revenue)", [("beta", "first_category", "1", True), *_DID_FIXED, ("delta", "first_category", _POLICY, True), _SLOPE], "spend"))
_sql("map_certificate_revenue_naive", _certificate("revenue_rows", _BACK, [
    ("alpha", "first_category", "1", True), ("tau", "first_category", "treatment", True)], "repeat") + " UNION ALL " + _certificate(
    _SPENDERS, "ln(repeat_revenue)", [("beta", "first_category", "1", True), ("delta", "first_category", "treatment", True), _SLOPE], "spend"))
_sql("map_certificate_review", _certificate("review_rows", "1", [
    ("beta", _CAT, "1", True), *_DID_FIXED, ("delta", _CAT, _POLICY, True), ("gamma_tier", "seller_volume_tier", "1", False)], "review", 4))
_sql("map_certificate_review_naive", _certificate("review_rows", "1", [
    ("beta", _CAT, "1", True), ("tau", _CAT, "treatment", True), ("gamma_tier", "seller_volume_tier", "1", False),
    ("delta_month", "calendar_month", "1", False)], "review", 4))
