"""Lean roll-ups, and frames read from roll-ups that are stored once."""

import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import analytics, facts, features
from bazaarlens.plans.queries import QUERIES, SPEC, Study
from bazaarlens.sources.binding import LINE_ORDER, STAR_SCHEMAS, SUBTOTAL_THRESHOLD

LINES = "order_id bigint, product_id bigint, category_en string, seller_id bigint, price double, freight_value double, line_revenue double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Star tables with repeated orders and customers, null keys, orders without lines and equal line numbers."""
    root, rng = str(tmp_path_factory.mktemp("star")), random.Random(5)
    days = [F.to_date(F.lit("1996-01-01")) + F.lit(7 * w) for w in range(40)]

    def save(name, rows, date=None):
        schema = " ".join(STAR_SCHEMAS[name].split())
        if date:
            schema = schema.replace(f"{date} timestamp_ntz", f"{date} int")
        df = spark.createDataFrame(rows, schema)
        if date:
            df = df.withColumn(date, F.get(F.array(*days), F.col(date)).cast("timestamp_ntz"))
        df.coalesce(2).write.parquet(f"{root}/{name}.parquet")

    orders = [(i, rng.choice([None, *range(200)]), "O", 1.0, rng.randrange(40), "1") for i in range(500)]
    lines = []
    for key in [*[i for i in range(500) if i % 9], None]:
        for _ in range(rng.randint(1, 4)):
            line = (key, rng.choice([None, 1, 2, 3]), rng.choice([None, *range(8)]), rng.randint(1, 2), 1.0,
                    rng.choice([None, 100_000.0, 300_000.5]), 0.0, rng.choice([0.01, 0.05]), rng.choice("AR"), "O", rng.randrange(40))
            lines.append(line)
    save("orders", orders + orders[:20], "o_orderdate")
    save("lineitem", lines + lines[:15], "l_shipdate")
    people = [(i, f"c{i}", i % 3, 1.0, "x") for i in range(200)]
    save("customer", people + people[:4])
    save("nation", [(i, f"n{i}", 0) for i in range(3)])
    save("supplier", [(i, f"s{i}", i % 3, 1.0) for i in range(8)])
    save("part", [(i, "p", f"Brand#{i % 2}", "t", 1, 1.0) for i in range(1, 4)])
    return root


def near(got, wanted):
    def plain(table):
        return [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in table]

    assert got and plain(got) == plain(wanted)


def test_lean_item_rollup_equals_the_full_one_without_marks_it_does_not_count(spark, rows):
    items = spark.createDataFrame(
        [(1, 1, "a", 1, 2.0, 0.5, 2.5), (1, 2, "b", 1, None, 0.5, None), (1, 2, "b", 2, 1.0, None, None), (2, None, None, None, 4.0, 1.0, 5.0),
         (None, 1, "a", 1, 3.0, 0.0, 3.0), (None, 1, "a", 1, 3.0, 0.0, 3.0)], LINES)
    wanted = ["n_items", "items_subtotal", "avg_unit_price", "dominant_category"]
    full = facts.item_rollup(items)
    assert full.columns == ["order_id", *facts.ITEM_COLUMNS]
    lean = facts.item_rollup(items, wanted)
    assert rows(lean) == rows(full.select("order_id", *wanted))
    assert "Generate" not in lean._jdf.queryExecution().optimizedPlan().toString()
    sellers = ["n_unique_sellers", "n_unique_categories"]
    assert rows(facts.item_rollup(items, sellers)) == rows(full.select("order_id", *sellers))


def test_lean_payment_rollup_equals_the_full_one(spark, rows):
    payments = spark.createDataFrame(
        [(1, "A", 2, 1.5), (1, "R", 3, None), (2, None, None, None), (None, "A", 1, 4.0), (None, "A", 1, 4.0)],
        "order_id bigint, payment_type string, payment_installments int, payment_value double")
    wanted = ["payment_total", "n_payments", "max_installments"]
    assert rows(facts.payment_rollup(payments, wanted)) == rows(facts.payment_rollup(payments).select("order_id", *wanted))


def test_frames_of_stored_rollups_equal_those_of_the_full_facts(spark, rows, folder):
    kept, plain = Study(spark, folder), Study(spark, folder)
    spec = features.finalise_spec(plain.cells, SPEC, weight="n_orders")
    house = plain.house
    wanted = features.customer_revenue_frame(analytics.repeat_revenue(house.fact_orders), spec)
    near(rows(kept.revenue), rows(wanted))
    full = facts.order_rollups(house.orders, house.raw["order_payments"], house.order_lines, house.order_reviews)
    wanted = features.review_frame(full, analytics.first_line_sellers(house.lines, LINE_ORDER), plain.tiers, spec)
    near(rows(kept.reviews), rows(wanted.select(*kept.reviews.columns)))
    near(rows(kept.cells), rows(plain.cells))


def test_queries_of_both_cutover_and_frames_read_the_lines_once(spark, folder):
    study = Study(spark, folder)
    assert study.revenue.count() and study.reviews.count()
    for table in (study.house.repeat_revenue, study.house.order_rollups):
        assert not [f for f in table.inputFiles() if "lineitem" in f or "orders.parquet" in f]


def test_spending_read_from_stored_facts_where_there_are_some(spark, rows, folder):
    house = Study(spark, folder).house
    lean = rows(house.repeat_revenue)
    again = Study(spark, folder).house
    again.replace("fact_orders", again.fact_orders)
    near(rows(again.repeat_revenue), lean)


def test_freight_column_is_stored_when_asked_for(spark, folder):
    study = Study(spark, folder)
    assert "items_freight" in study.keep_orders("items_freight").columns
    cells = features.freight_cells(study.keep_orders("items_freight"), study.spec)
    assert cells.count() > 1


def test_pre_trend_has_the_columns_it_reads(spark, rows, folder):
    weekly = features.weekly_by_eligibility(Study(spark, folder).house.order_rollups, SUBTOTAL_THRESHOLD)
    kept = features.weekly_by_eligibility(Study(spark, folder).keep_orders("items_freight"), SUBTOTAL_THRESHOLD)
    near(rows(kept), rows(weekly))
    assert QUERIES["pre_trend"](spark, folder).count()
