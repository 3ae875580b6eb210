"""Edge cases of the cleaned tables and facts, on inline rows in the raw schema."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import calendar as cal
from bazaarlens.functions import expressions as ex
from bazaarlens.operators import analytics, cleaning, facts, quality
from bazaarlens.sources.schemas import raw_schema


def at(text):
    return datetime.fromisoformat(text)


def order(oid, cid, bought, status="delivered", delivered=None, promised=None, approved=None, carrier=None):
    return (oid, cid, status, at(bought) if bought else None, approved, carrier, delivered, promised)


def frame(spark, name, data):
    return spark.createDataFrame(data, raw_schema(name))


@pytest.mark.parametrize(
    "unit, a, b, crossed",
    [
        ("day", "2018-01-01 23:00", "2018-01-02 01:00", 1),
        ("hour", "2018-01-01 23:00", "2018-01-02 01:00", 2),
        ("month", "2018-01-31 00:00", "2018-02-01 00:00", 1),
        ("hour", "2018-01-01 00:59", "2018-01-01 01:01", 1),
        ("minute", "2018-01-01 00:59:59", "2018-01-01 01:00:00", 1),
        ("day", "2018-01-02 01:00", "2018-01-01 23:00", -1),
    ],
)
def test_boundaries_not_elapsed(spark, unit, a, b, crossed):
    df = spark.createDataFrame([(at(a), at(b))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(cal.boundary_diff(unit, "a", "b")).first()[0] == crossed


def test_unknown_unit():
    with pytest.raises(ValueError, match="week"):
        cal.boundary_diff("week", F.lit(1), F.lit(2))


def test_grains(spark):
    df = spark.createDataFrame([(at("2018-03-04 22:10"),)], "t timestamp_ntz")  # a Sunday
    row = df.select(
        cal.week_of("t").cast("string"), cal.month_of("t").cast("string"), cal.day_of_week("t"), cal.hour_of("t")
    ).first()
    assert tuple(row) == ("2018-02-26", "2018-03-01", 0, 22)


def test_first_address_and_ties(spark, rows):
    customers = frame(spark, "customers", [
        ("c1", "p1", "01000", "second city", "SP"), ("c2", "p1", "02000", "first city", "RJ"),
        ("c3", "p2", "03000", "tie b", "SP"), ("c4", "p2", "04000", "tie a", "SP"),
        ("c5", "p3", "05000", "no order", "MG"),
    ])
    orders = frame(spark, "orders", [
        order("o1", "c1", "2018-05-01"), order("o2", "c2", "2018-01-01"),
        order("o4", "c3", "2018-01-01"), order("o3", "c4", "2018-01-01"),
    ])
    got = cleaning.customers_first_address(customers, orders)
    assert rows(got, "customer_unique_id", "first_city", "first_zip_code_prefix") == [
        ("p1", "first city", "02000"), ("p2", "tie a", "04000"), ("p3", "no order", "05000"),
    ]
    assert got.where("customer_unique_id = 'p3'").first().first_order_at is None


def test_latest_review_prefers_answered(spark, rows):
    reviews = frame(spark, "order_reviews", [
        ("r1", "o1", 5, None, None, None, None), ("r2", "o1", 2, None, None, None, at("2018-01-01")),
        ("r3", "o1", 3, None, None, None, at("2018-01-05")), ("r4", "o2", 4, None, None, None, None),
    ])
    assert rows(cleaning.reviews_latest(reviews), "order_id", "review_id", "review_score") == [
        ("o1", "r3", 3), ("o2", "r4", 4),
    ]


def test_products(spark):
    products = frame(spark, "products", [
        ("p1", "moveis", 1, 2, 3, 100, 10, 20, 30), ("p2", "sem nome", 1, 2, 3, None, 10, None, 30),
        ("p3", None, 1, 2, 3, 5, 100000, 100000, 100000), ("p4", "moveis", 1, 2, 3, 5, 1, None, None),
    ])
    words = frame(spark, "category_translation", [("moveis", "furniture")])
    got = {r.product_id: r for r in cleaning.products_clean(products, words).collect()}
    assert (got["p1"].category_en, got["p1"].volume_cm3, got["p1"].has_missing_attributes) == ("furniture", 6000, False)
    assert (got["p2"].category_en, got["p2"].volume_cm3, got["p2"].has_missing_attributes) == ("sem nome", None, True)
    assert (got["p3"].category_en, got["p3"].volume_cm3, got["p3"].has_missing_attributes) == (None, 10**15, True)
    assert got["p4"].has_missing_attributes is False  # height and width are not checked
    assert "name_length" in cleaning.products_clean(products).columns


def test_centroid_and_modal_city(spark):
    points = frame(spark, "geolocation", [
        ("1", 1.0, 10.0, "b", "SP"), ("1", 2.0, 20.0, "a", "SP"), ("1", None, 30.0, "b", "SP"), ("1", 3.0, 40.0, "a", "SP"),
        ("2", 5.0, 5.0, None, "RJ"), ("2", 7.0, 5.0, "z", "RJ"),
    ])
    got = {r.zip_prefix: r for r in cleaning.geolocation_centroids(points).collect()}
    assert (got["1"].lat, got["1"].lng, got["1"].modal_city, got["1"].n_observations) == (2.0, 25.0, "a", 4)
    assert got["2"].modal_city == "z"  # a missing name sorts last


def test_order_flags(spark):
    orders = frame(spark, "orders", [
        order("o1", "c1", "2018-01-01 23:00", delivered=at("2018-01-02 01:00"), promised=at("2018-01-02 01:00")),
        order("o2", "c1", "2018-01-01", delivered=at("2018-01-09"), promised=at("2018-01-02")),
        order("o3", "c1", "2018-01-01", status="canceled", promised=at("2018-01-02")),
        order("o4", "c1", "2018-01-01", delivered=at("2018-01-09")),
    ])
    bridge = spark.createDataFrame([("c1", "p1")], "shipping_id string, customer_unique_id string")
    got = {r.order_id: r for r in cleaning.orders_enriched(orders, bridge).collect()}
    assert [got[o].is_on_time for o in ("o1", "o2", "o3", "o4")] == [True, False, False, None]
    assert (got["o1"].delivery_days, got["o2"].delivery_vs_estimate_days) == (1, 7)
    assert [got[o].is_lost for o in ("o1", "o3")] == [False, True]


def warehouse_frames(spark):
    orders = spark.createDataFrame(
        [("o1", "p1", at("2018-01-01 10:00"), at("2018-01-03")), ("o2", "p1", at("2018-01-31 09:00"), None),
         ("o3", "p1", at("2018-06-30 10:00"), None), ("o4", "p1", at("2018-06-30 10:00:01"), None),
         ("o5", "p2", at("2018-02-01"), None)],
        "order_id string, customer_unique_id string, order_purchase_timestamp timestamp_ntz,"
        "order_delivered_customer_date timestamp_ntz",
    ).withColumns({
        "purchase_week": cal.week_of("order_purchase_timestamp"),
        "is_on_time": F.lit(None).cast("boolean"),
    })
    payments = spark.createDataFrame(
        [("o1", "card", 2, 10.0), ("o1", "voucher", 5, 1.5), ("o2", "card", 1, 7.0), ("o3", "card", 1, 4.0), ("o4", "x", 1, 100.0)],
        "order_id string, payment_type string, payment_installments int, payment_value double",
    )
    items = spark.createDataFrame(
        [("o1", "a", "b", "s1", 10.0, 1.0), ("o1", "a", "c", "s1", 5.0, 1.0), ("o1", "d", None, "s2", 1.0, 0.0),
         ("o2", "a", None, "s1", 3.0, 0.5)],
        "order_id string, product_id string, category_en string, seller_id string, price double, freight_value double",
    ).withColumn("line_revenue", F.col("price") + F.col("freight_value"))
    reviews = spark.createDataFrame(
        [("o1", 4, at("2018-01-04"))], "order_id string, review_score int, review_answer_timestamp timestamp_ntz"
    )
    return orders, payments, items, reviews


def test_facts(spark):
    got = {r.order_id: r for r in facts.fact_orders(*warehouse_frames(spark)).collect()}
    one, two, five = got["o1"], got["o2"], got["o5"]
    assert (one.payment_total, one.n_payments, one.max_installments, one.dominant_payment_type) == (11.5, 2, 5, "card")
    assert (one.n_items, one.n_unique_products, one.n_unique_categories, one.n_unique_sellers) == (3, 2, 2, 2)
    assert (one.dominant_category, one.items_subtotal, one.max_unit_price, one.review_lag_days) == ("b", 16.0, 10.0, 1)
    assert (two.dominant_category, two.n_unique_categories) == (None, 0)
    assert (five.payment_total, five.n_items, five.items_subtotal) == (0.0, None, None)
    assert [got[f"o{i}"].customer_order_rank for i in range(1, 5)] == [1, 2, 3, 4]
    assert (two.days_since_prior_order, two.customer_total_orders, two.is_first_purchase) == (30, 4, False)


def test_repeat_window_boundaries(spark):
    repeat = analytics.repeat_revenue(facts.fact_orders(*warehouse_frames(spark)))
    got = {r.customer_unique_id: r for r in repeat.collect()}
    # 2018-01-01 10:00 + 180 days = 2018-06-30 10:00: that second counts, the next does not
    assert (got["p1"].repeat_revenue, got["p1"].n_repeat_orders, got["p1"].has_repeat) == (11.0, 2, True)
    assert (got["p2"].repeat_revenue, got["p2"].has_repeat) == (0.0, False)


def test_session_gap_is_strict(spark):
    got = {r.order_id: r.session_id for r in analytics.repeat_purchase(facts.fact_orders(*warehouse_frames(spark))).collect()}
    assert (got["o1"], got["o2"], got["o3"], got["o4"]) == (1, 1, 2, 2)  # 30 days keeps the session


def test_customer_and_seller_dimensions(spark):
    orders, payments, items, reviews = warehouse_frames(spark)
    fact = facts.fact_orders(orders, payments, items, reviews)
    address = spark.createDataFrame(
        [("p1", "1", "SP", "x")], "customer_unique_id string, first_zip_code_prefix string, first_state string, first_city string"
    )
    customers = {r.customer_unique_id: r for r in facts.dim_customer(fact, address).collect()}
    assert (customers["p1"].n_orders, customers["p1"].lifetime_revenue, customers["p1"].pct_on_time) == (4, 122.5, 0.0)
    assert customers["p2"].first_state is None and customers["p2"].is_repeat_customer is False
    products = spark.createDataFrame([("a", "b"), ("d", None)], "product_id string, category_en string")
    places = spark.createDataFrame([("s1", "SP", 1.0, 2.0)], "seller_id string, state string, lat double, lng double")
    sellers = {r.seller_id: r for r in facts.dim_seller(items, orders, products, places, reviews).collect()}
    assert (sellers["s1"].n_orders, sellers["s1"].n_unique_products, sellers["s1"].n_unique_categories) == (2, 1, 1)
    assert sellers["s1"].avg_review_score == 4.0 and sellers["s2"].seller_state is None
    assert sellers["s2"].n_unique_categories == 0
    early = facts.dim_seller(items, orders, products, places, reviews, as_of=at("2018-01-15"))
    assert {r.seller_id: r.n_orders for r in early.collect()} == {"s1": 1, "s2": 1}


def test_retention_spine(spark):
    fact = facts.fact_orders(*warehouse_frames(spark))
    plain = analytics.cohort_retention(fact).collect()
    assert [(str(r.cohort_month), r.month_offset, r.active_customers) for r in plain] == [
        ("2018-01-01", 0, 1), ("2018-01-01", 5, 1), ("2018-02-01", 0, 1),
    ]
    filled = analytics.cohort_retention(fact, fill_spine=True)
    assert filled.count() == 6 + 5 and filled.agg(F.sum("active_customers")).first()[0] == 3


def test_quality_checks(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (1, -2.0), (None, 3.0)], "k int, v double")
    parent = spark.createDataFrame([(1,)], "k int")
    checks = quality.stack_checks(
        quality.unique_check(df, "k", "u"), quality.unique_check(parent, "k", "v"),
        quality.fk_check(df, parent, "k", "f"), quality.range_check(df, "v", "r", low=0),
        quality.reconciliation_check(df, df, "c"), quality.reconciliation_check(df, df.where("k = 1"), "d"),
    )
    assert rows(checks) == [
        ("c", "ok", "0.000000"), ("d", "FAIL", "0.333333"), ("f", "FAIL", "1"), ("r", "FAIL", "1"), ("u", "FAIL", "3"), ("v", "ok", "1"),
    ]


def test_treated_below_threshold_is_reported(spark):
    df = spark.createDataFrame([(1, 10.0), (0, 5.0), (1, 4.0), (1, None)], "t int, s double")
    assert quality.treated_threshold_check(df, "t", "s", 10.0, "x").first().observed == "2"


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(1.0, 0.0, True, 0.0), (0.2, 2.0, None, 5.0)], "a double, b double, r boolean, v double")
    got = df.select(
        ex.safe_ratio("a", "b"), ex.floored_log("a"), ex.economic_repeat("r", "v"), ex.score_index("b")
    ).collect()
    assert [tuple(r) for r in got] == [(None, 0.0, 0, -1), (0.1, 0.0, 0, 1)]
