"""ANSI SQL twins of the registered queries, for an independent engine on the same tables.

Statements are assembled from named common table expressions; each names what it needs.
Doubles are rounded the same way on both sides because sums depend on addition order.
"""

from __future__ import annotations

THRESHOLD = 275000.0

CTES: dict[str, str] = {}


def _cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _words(text: str) -> set[str]:
    out, word = set(), ""
    for ch in text:
        if ch.isalnum() or ch == "_":
            word += ch
        else:
            out.add(word)
            word = ""
    return out | {word}


def with_ctes(query: str) -> str:
    """Prefix `query` with every CTE it names, directly or through another CTE."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name in _words(text) and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in needed) + "\n" + query.strip()


# ---------------------------------------------------------------- raw tables -------
_cte("raw_orders", """
SELECT o_orderkey AS order_id, o_custkey || '-' || o_orderkey AS customer_id, o_custkey AS person,
  CASE WHEN o_orderkey % 40 = 0 THEN 'canceled' WHEN o_orderkey % 40 = 1 THEN 'unavailable'
       WHEN o_orderkey % 40 IN (2, 3) THEN 'shipped' ELSE 'delivered' END AS order_status,
  o_orderdate + to_hours((o_orderkey * 7) % 24) AS purchased,
  CASE WHEN o_orderkey % 50 <> 0
    THEN o_orderdate + to_hours((o_orderkey * 7) % 24 + (o_orderkey * 11) % 72) END AS approved,
  CASE WHEN o_orderkey % 40 NOT IN (0, 1)
    THEN o_orderdate + to_hours((o_orderkey * 7) % 24 + 72 + (o_orderkey * 5) % 96) END AS carried,
  CASE WHEN o_orderkey % 40 NOT IN (0, 1, 2, 3)
    THEN o_orderdate + to_hours((o_orderkey * 7) % 24 + 24 * (3 + (o_orderkey * 13) % 29)) END AS received,
  o_orderdate + INTERVAL 24 DAY AS promised
FROM orders""")

_cte("raw_customers", """
SELECT o_custkey || '-' || o_orderkey AS customer_id, o_custkey AS customer_unique_id,
  CAST(c_nationkey AS VARCHAR) AS zip, c_mktsegment AS city, n_name AS state
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")

_cte("raw_items", """
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
  l_shipdate AS shipping_limit_date, l_extendedprice AS price,
  l_extendedprice * l_tax AS freight_value, l_returnflag, l_quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity, l_shipdate, l_tax, l_discount, l_returnflag, l_linestatus) AS order_item_id
FROM lineitem""")

_cte("raw_payments", """
SELECT order_id, order_item_id AS payment_sequential, l_returnflag AS payment_type,
  CAST(l_quantity AS INTEGER) AS payment_installments, price + freight_value AS payment_value
FROM raw_items""")

_cte("raw_reviews", """
SELECT o_orderkey * 10 AS review_id, o_orderkey AS order_id,
  CAST(1 + (o_orderkey * 31 % 97) % 5 AS INTEGER) AS review_score,
  o_orderdate + INTERVAL 28 DAY AS created, o_orderdate + INTERVAL 30 DAY AS answered
FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL
SELECT o_orderkey * 10 + 1, o_orderkey, CAST(1 + (o_orderkey * 17 % 89) % 5 AS INTEGER),
  o_orderdate + INTERVAL 31 DAY, o_orderdate + INTERVAL 33 DAY
FROM orders WHERE o_orderkey % 25 = 1""")

_cte("raw_geo", """
SELECT CAST(c_nationkey AS VARCHAR) AS zip, c_acctbal AS lat, c_acctbal * 0.5 AS lng,
  c_mktsegment AS city, n_name AS state
FROM customer JOIN nation ON n_nationkey = c_nationkey""")

_cte("raw_sellers", """
SELECT s_suppkey AS seller_id, CAST(s_nationkey AS VARCHAR) AS zip, s_name AS city, n_name AS state
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")

_cte("raw_translation", """
SELECT DISTINCT p_brand AS label, 'category ' || split_part(p_brand, '#', 2) AS label_en
FROM part WHERE p_brand NOT LIKE '%5'""")

# ------------------------------------------------------------------- silver --------
_cte("s_customers", """
SELECT customer_unique_id, zip AS first_zip_code_prefix, city AS first_city, state AS first_state,
  purchased AS first_order_at
FROM (SELECT c.*, o.purchased, row_number() OVER (PARTITION BY customer_unique_id
        ORDER BY o.purchased ASC NULLS LAST, o.order_id) AS rn
      FROM raw_customers c LEFT JOIN raw_orders o ON o.customer_id = c.customer_id)
WHERE rn = 1""")

_cte("s_geo", """
SELECT z.zip AS zip_prefix, z.lat, z.lng, m.city AS modal_city, m.state AS modal_state, z.n AS n_observations
FROM (SELECT zip, avg(lat) AS lat, avg(lng) AS lng, count(*) AS n FROM raw_geo GROUP BY zip) z
LEFT JOIN (SELECT zip, city, state, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, city, state) AS rn
           FROM raw_geo GROUP BY zip, city, state) m
  ON m.zip = z.zip AND m.rn = 1""")

_cte("s_sellers", """
SELECT s.seller_id, s.zip AS zip_prefix, s.city, s.state, g.lat, g.lng
FROM raw_sellers s LEFT JOIN s_geo g ON g.zip_prefix = s.zip""")

_cte("s_orders", """
SELECT o.order_id, o.customer_id, c.customer_unique_id, o.order_status,
  o.purchased AS order_purchase_timestamp, o.approved AS order_approved_at,
  o.carried AS order_delivered_carrier_date, o.received AS order_delivered_customer_date,
  o.promised AS order_estimated_delivery_date,
  CAST(o.purchased AS DATE) AS purchase_date,
  CAST(date_trunc('week', o.purchased) AS DATE) AS purchase_week,
  CAST(date_trunc('month', o.purchased) AS DATE) AS purchase_month,
  CAST(extract(dow FROM o.purchased) AS BIGINT) AS purchase_dow,
  CAST(extract(hour FROM o.purchased) AS BIGINT) AS purchase_hour,
  date_diff('minute', o.purchased, o.approved) AS approval_lag_minutes,
  date_diff('day', o.purchased, o.received) AS delivery_days,
  date_diff('day', o.promised, o.received) AS delivery_vs_estimate_days,
  o.order_status = 'delivered' AS is_delivered,
  o.order_status IN ('canceled', 'unavailable') AS is_lost,
  o.received IS NOT NULL AND o.received <= o.promised AS is_on_time
FROM raw_orders o LEFT JOIN raw_customers c ON c.customer_id = o.customer_id""")

_cte("s_items", """
SELECT i.order_id, i.order_item_id, i.product_id, p.p_brand AS category_en, i.seller_id,
  s.state AS seller_state, i.shipping_limit_date, i.price, i.freight_value,
  i.price + i.freight_value AS line_revenue
FROM raw_items i LEFT JOIN part p ON p.p_partkey = i.product_id
LEFT JOIN raw_sellers s ON s.seller_id = i.seller_id""")

_cte("s_reviews", """
SELECT review_id, order_id, review_score, created AS review_creation_date, answered AS review_answer_timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY answered DESC NULLS LAST, review_id DESC) AS rn
      FROM raw_reviews)
WHERE rn = 1""")

# --------------------------------------------------------------------- gold --------
# Labels are tallied once per (order, kind, label). The number of distinct labels is then the number of tallies, and the mode
# the tally with the largest count, the smallest label among equals.
_cte("tallies", """
SELECT order_id, 'payment' AS kind, payment_type AS label, count(*) AS c FROM raw_payments GROUP BY ALL
UNION ALL SELECT order_id, 'product', CAST(product_id AS VARCHAR), count(*) FROM s_items GROUP BY ALL
UNION ALL SELECT order_id, 'seller', CAST(seller_id AS VARCHAR), count(*) FROM s_items GROUP BY ALL
UNION ALL SELECT order_id, 'category', category_en, count(*) FROM s_items GROUP BY ALL""")

_cte("order_labels", """
SELECT order_id, count(*) FILTER (kind = 'product') AS n_unique_products, count(*) FILTER (kind = 'category') AS n_unique_categories,
  count(*) FILTER (kind = 'seller') AS n_unique_sellers,
  arg_min(label, {'c': -c, 'l': label}) FILTER (kind = 'payment') AS dominant_payment_type,
  arg_min(label, {'c': -c, 'l': label}) FILTER (kind = 'category') AS dominant_category
FROM tallies WHERE label IS NOT NULL GROUP BY order_id""")

_cte("pay_roll", """
SELECT m.*, l.dominant_payment_type FROM (
  SELECT order_id, sum(payment_value) AS payment_total, count(*) AS n_payments, max(payment_installments) AS max_installments
  FROM raw_payments GROUP BY order_id) m LEFT JOIN order_labels l USING (order_id)""")

_cte("item_roll", """
SELECT m.*, coalesce(l.n_unique_products, 0) AS n_unique_products, coalesce(l.n_unique_categories, 0) AS n_unique_categories,
  coalesce(l.n_unique_sellers, 0) AS n_unique_sellers, l.dominant_category
FROM (SELECT order_id, count(*) AS n_items, max(price) AS max_unit_price, sum(price) / count(price) AS avg_unit_price,
        sum(price) AS items_subtotal, sum(freight_value) AS items_freight, sum(line_revenue) AS items_revenue
      FROM s_items GROUP BY order_id) m LEFT JOIN order_labels l USING (order_id)""")

# A customer's orders in one sorted list: places in it give ranks, totals and the order before.
_cte("visits", """
SELECT customer_unique_id, list_sort(list({'t': order_purchase_timestamp, 'o': order_id}), 'ASC', 'NULLS LAST') AS v
FROM s_orders GROUP BY customer_unique_id""")

_cte("places", """
SELECT v[i].o AS order_id, i AS customer_order_rank, len(v) AS customer_total_orders, i = 1 AS is_first_purchase,
  date_diff('day', v[i - 1].t, v[i].t) AS days_since_prior_order, v[1].t AS opened
FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM visits)""")

_cte("facts", """
SELECT * EXCLUDE (opened, payment_total, answered), coalesce(payment_total, 0.0) AS payment_total,
  date_diff('day', order_delivered_customer_date, answered) AS review_lag_days
FROM s_orders JOIN places USING (order_id) LEFT JOIN pay_roll USING (order_id) LEFT JOIN item_roll USING (order_id)
LEFT JOIN (SELECT order_id, review_score, review_answer_timestamp AS answered FROM s_reviews) USING (order_id)""")


def _quarter(place: str, rows: str) -> str:
    """Which quarter holds the row at `place` (from 0) of `rows`: the first `rows % 4` quarters have one row more."""
    long = f"({rows} % 4) * ({rows} // 4 + 1)"
    return f"""CASE WHEN {place} < {long} THEN {place} // ({rows} // 4 + 1)
    ELSE {rows} % 4 + ({place} - {long}) // greatest({rows} // 4, 1) END + 1"""


_cte("d_customer", f"""
SELECT q.*, c.first_zip_code_prefix, c.first_state, c.first_city,
  ['low', 'mid_low', 'mid_high', 'high'][spend_quartile] AS spend_tier, n_orders > 1 AS is_repeat_customer
FROM (SELECT * EXCLUDE (place, amount), CAST({_quarter("place", "amount")} AS BIGINT) AS spend_quartile
  FROM (SELECT *, row_number() OVER (ORDER BY round(lifetime_revenue, 4), customer_unique_id) - 1 AS place, count(*) OVER () AS amount
    FROM (SELECT customer_unique_id, any_value(v[1].t) AS first_order_at, any_value(v[len(v)].t) AS last_order_at,
            CAST(date_trunc('month', any_value(v[1].t)) AS DATE) AS cohort_month, any_value(len(v)) AS n_orders,
            sum(payment_total) AS lifetime_revenue, sum(payment_total) / count(*) AS avg_order_value,
            sum(review_score) / CAST(count(review_score) AS DOUBLE) AS avg_review_score,
            count(*) FILTER (is_on_time) / CAST(count(*) AS DOUBLE) AS pct_on_time
          FROM facts JOIN visits USING (customer_unique_id) GROUP BY customer_unique_id))) q
LEFT JOIN s_customers c USING (customer_unique_id)""")

# A seller's orders as distinct pairs with their number of lines; reviews weigh by lines.
_cte("seller_orders", """
SELECT seller_id, order_id, count(*) AS n_lines, sum(line_revenue) AS revenue FROM s_items GROUP BY seller_id, order_id""")

AS_OF = "1997-01-01 00:00:00"


def _seller_tables(suffix: str, orders: str) -> None:
    """Ranges and lifetimes of sellers over the orders given."""
    _cte(f"seller_range{suffix}", f"""
SELECT seller_id, count(product_id) AS n_unique_products, count(DISTINCT category_en) AS n_unique_categories
FROM (SELECT DISTINCT seller_id, product_id, category_en FROM s_items JOIN {orders} USING (order_id)) GROUP BY seller_id""")
    _cte(f"d_seller{suffix}", f"""
SELECT * EXCLUDE (place, amount, volume_quartile), CAST(volume_quartile AS BIGINT) AS volume_quartile,
  ['small', 'mid_small', 'mid_large', 'large'][volume_quartile] AS volume_tier
FROM (SELECT *, {_quarter("place", "amount")} AS volume_quartile
  FROM (SELECT *, row_number() OVER (ORDER BY n_orders, seller_id) - 1 AS place, count(*) OVER () AS amount
    FROM (SELECT seller_id, count(*) AS n_orders, min(o.order_purchase_timestamp) AS first_seen_at,
            max(o.order_purchase_timestamp) AS last_seen_at, sum(revenue) AS lifetime_revenue,
            sum(revenue) / sum(n_lines) AS avg_line_revenue,
            sum(n_lines * review_score) / CAST(sum(n_lines) FILTER (review_score IS NOT NULL) AS DOUBLE) AS avg_review_score
          FROM seller_orders JOIN {orders} o USING (order_id) LEFT JOIN s_reviews USING (order_id) GROUP BY seller_id)
    JOIN seller_range{suffix} USING (seller_id)
    LEFT JOIN (SELECT seller_id, state AS seller_state, lat AS seller_lat, lng AS seller_lng FROM s_sellers) USING (seller_id)))""")


_seller_tables("", "s_orders")
_cte("early_orders", f"SELECT * FROM s_orders WHERE order_purchase_timestamp < TIMESTAMP '{AS_OF}'")
_seller_tables("_early", "early_orders")

# ---------------------------------------------------------------- analytics --------
_cte("retention", """
SELECT a.cohort_month, a.activity_month, date_diff('month', a.cohort_month, a.activity_month) AS month_offset,
  s.n AS cohort_size, a.n AS active_customers, CAST(a.n AS DOUBLE) / s.n AS retention_rate
FROM (SELECT c.cohort_month, m.activity_month, count(DISTINCT m.customer_unique_id) AS n
      FROM first_months c JOIN (SELECT DISTINCT customer_unique_id, purchase_month AS activity_month FROM s_orders) m
        ON m.customer_unique_id = c.customer_unique_id
      GROUP BY c.cohort_month, m.activity_month) a
JOIN (SELECT cohort_month, count(*) AS n FROM first_months GROUP BY cohort_month) s
  ON s.cohort_month = a.cohort_month""")

_cte("first_months", """
SELECT customer_unique_id, min(purchase_month) AS cohort_month FROM s_orders GROUP BY customer_unique_id""")

# One pass over a customer's orders, each of which knows when the first one was.
_cte("repeats", """
SELECT customer_unique_id, any_value(opened) AS first_order_at, max(purchase_week) FILTER (is_first_purchase) AS first_order_week,
  max(items_subtotal) FILTER (is_first_purchase) AS first_subtotal, max(dominant_category) FILTER (is_first_purchase) AS first_category,
  max(payment_total) FILTER (is_first_purchase) AS first_payment_total, coalesce(sum(payment_total) FILTER (soon), 0.0) AS repeat_revenue,
  CAST(count(*) FILTER (soon) AS INTEGER) AS n_repeat_orders, count(*) FILTER (soon) > 0 AS has_repeat
FROM (SELECT f.*, opened, NOT f.is_first_purchase AND order_purchase_timestamp > opened
        AND order_purchase_timestamp - opened <= INTERVAL 180 DAY AS soon
      FROM facts f JOIN (SELECT order_id, opened FROM places) USING (order_id))
GROUP BY customer_unique_id""")

_cte("anchors", "SELECT order_id, seller_id FROM raw_items WHERE order_item_id = 1")

# ----------------------------------------------------------------- features --------
_cte("covariates", """
SELECT order_id, customer_unique_id, purchase_week, purchase_month, CAST(month(purchase_date) AS INTEGER) AS calendar_month,
  customer_state, seller_volume_tier, seller_state, dominant_category AS category_en,
  is_delivered, is_lost, is_on_time, review_score, n_items, payment_total, items_subtotal, items_freight
FROM facts LEFT JOIN (SELECT customer_unique_id, first_state AS customer_state FROM s_customers) USING (customer_unique_id)
LEFT JOIN (SELECT order_id, volume_tier AS seller_volume_tier, seller_state FROM anchors JOIN d_seller USING (seller_id)) USING (order_id)
WHERE purchase_date IS NOT NULL""")

_cte("complete", """
SELECT * FROM covariates
WHERE purchase_week <= (SELECT max(purchase_week) - 42 FROM covariates)
  AND category_en IS NOT NULL AND seller_volume_tier IS NOT NULL AND customer_state IS NOT NULL""")

_cte("cutover", "SELECT median(date_diff('day', DATE '1970-01-01', purchase_week)) AS day FROM complete")


def _treated(source: str, week: str, subtotal: str) -> str:
    return f"""
SELECT t.*, CASE WHEN coalesce({subtotal}, 0) >= {THRESHOLD} THEN 1 ELSE 0 END AS eligible,
  CASE WHEN date_diff('day', DATE '1970-01-01', {week}) >= c.day THEN 1 ELSE 0 END AS post,
  CASE WHEN coalesce({subtotal}, 0) >= {THRESHOLD}
        AND date_diff('day', DATE '1970-01-01', {week}) >= c.day THEN 1 ELSE 0 END AS treatment
FROM {source} t CROSS JOIN cutover c"""


_cte("frame", f"""
SELECT f.*, CAST(dense_rank() OVER (ORDER BY category_en) - 1 AS INTEGER) AS category_en_code,
  CAST(dense_rank() OVER (ORDER BY seller_volume_tier) - 1 AS INTEGER) AS seller_volume_tier_code,
  CAST(dense_rank() OVER (ORDER BY customer_state) - 1 AS INTEGER) AS customer_state_code,
  CAST(dense_rank() OVER (ORDER BY calendar_month) - 1 AS INTEGER) AS calendar_month_code
FROM ({_treated("complete", "purchase_week", "items_subtotal")}) f""")

_cte("revenue_rows", f"""
SELECT *, CASE WHEN has_repeat AND repeat_revenue > 0 THEN 1 ELSE 0 END AS economic_repeat,
  ln(greatest(first_subtotal, 1.0)) AS log_first_subtotal
FROM ({_treated("(SELECT * FROM repeats WHERE first_category IS NOT NULL AND first_subtotal IS NOT NULL)",
                "first_order_week", "first_subtotal")})
QUALIFY count(*) OVER (PARTITION BY first_category) >= 50""")

_SCORED = """(SELECT order_id, customer_unique_id, review_score, payment_total, items_subtotal, purchase_week, category_en, is_delivered,
  calendar_month, seller_volume_tier FROM covariates
  WHERE is_delivered AND review_score > 0 AND category_en > '' AND seller_volume_tier > '')"""
_cte("review_rows", f"""
SELECT * EXCLUDE (alike), review_score - 1 AS score_index
FROM (SELECT *, count(*) OVER (PARTITION BY category_en) AS alike FROM ({_treated(_SCORED, "purchase_week", "items_subtotal")}))
WHERE alike >= 50""")

_cte("did_cells", """
SELECT category_en_code, seller_volume_tier_code, customer_state_code, eligible, post,
  count(*) AS n_orders, sum(CAST(is_delivered AS INTEGER)) AS n_delivered,
  sum(CAST(is_on_time AS INTEGER)) AS n_on_time, avg(items_subtotal) AS avg_subtotal
FROM frame GROUP BY ALL""")
