"""Roll-ups deal their rows once, in either way of counting labels."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import facts
from bazaarlens.operators.ordered import split_crowded
from bazaarlens.plans import queries
from bazaarlens.sources.binding import STAR_SCHEMAS

LINES = "order_id bigint, product_id bigint, category_en string, seller_id bigint, price double, freight_value double, line_revenue double"


def final_exchanges(df):
    """Shuffles of the plan as it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    ran = plan.split("== Initial Plan ==")[0]
    return [line for line in ran.splitlines() if " Exchange " in line]


@pytest.fixture(scope="module")
def lines():
    rng, out = random.Random(3), []
    for key in [*range(60), None]:
        for _ in range(rng.choice([1, 2, 5, 40])):
            price = rng.choice([None, *map(float, range(9))])
            out.append((key, rng.choice([None, *range(30)]), rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3]), price,
                        rng.choice([None, 0.5]), None if price is None else price + 0.5))
    return out + [(99, 1, "z", 1, 1.0, 0.5, 1.5)] * 50 + [(100, None, None, None, None, None, None)]


def by_hand(lines):
    orders = collections.defaultdict(list)
    for line in lines:
        orders[line[0]].append(line)
    for key, kept in orders.items():
        products, categories, sellers, prices, freights, revenues = ([x[i] for x in kept if x[i] is not None] for i in range(1, 7))
        often = collections.Counter(categories)
        yield (
            key, len(kept), len(set(products)), len(often), len(set(sellers)),
            sum(prices) if prices else None, sum(freights) if freights else None, sum(revenues) if revenues else None,
            sum(prices) / len(prices) if prices else None, max(prices, default=None),
            min(often, key=lambda c: (-often[c], c)) if often else None,
        )


@pytest.mark.parametrize("lines_per_sample", [1, 7, 50_000])
def test_item_rollup_by_hand_whichever_orders_are_crowded(spark, rows, lines, lines_per_sample):
    got = facts.item_rollup(spark.createDataFrame(lines, LINES), lines_per_sample=lines_per_sample)
    assert got.columns == ["order_id", *facts.ITEM_COLUMNS]
    wanted = sorted(by_hand(lines), key=lambda t: (t[0] is None, t[0]))
    assert sorted(map(tuple, got.collect()), key=lambda t: (t[0] is None, t[0])) == wanted


def test_groups_are_split_whole_and_null_keys_are_one(spark, lines):
    few, many = split_crowded(spark.createDataFrame(lines, LINES), "order_id", ["product_id", "price"], 1)
    sizes = collections.Counter(line[0] for line in lines)
    assert {(r.order_id, r["count"]) for r in few.groupBy("order_id").count().collect()} == {(k, n) for k, n in sizes.items() if n < 4}
    assert {(r.order_id, r["count"]) for r in many.groupBy("order_id").count().collect()} == {(k, n) for k, n in sizes.items() if n >= 4}


def test_lines_are_dealt_once(spark, lines):
    items = spark.createDataFrame(lines, LINES)
    assert len(final_exchanges(facts.item_rollup(items))) == 1
    assert len(final_exchanges(facts.item_rollup(items, facts.MODEL_COLUMNS[1:5]))) == 1


def test_payments_are_dealt_once_and_the_smallest_of_equally_frequent_types_counts(spark, rows):
    payments = spark.createDataFrame(
        [(1, "R", 2, 1.5), (1, "A", 3, None), (1, None, 9, 1.0), (1, None, 9, 1.0), (1, None, 9, 1.0), (2, None, None, None),
         (None, "A", 1, 4.0), (None, "R", 1, 4.0), (None, "R", 1, 4.0)],
        "order_id bigint, payment_type string, payment_installments int, payment_value double")
    got = facts.payment_rollup(payments)
    assert rows(got) == [(1, 4.5, 5, 9, "A"), (2, None, 1, None, None), (None, 12.0, 3, 1, "R")]
    assert len(final_exchanges(got)) == 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, rng = str(tmp_path_factory.mktemp("star")), random.Random(8)

    def save(name, rows, date=None):
        schema = " ".join(STAR_SCHEMAS[name].split())
        if date:
            schema = schema.replace(f"{date} timestamp_ntz", f"{date} int")
        df = spark.createDataFrame(rows, schema)
        if date:
            df = df.withColumn(date, F.timestamp_seconds(F.col(date) * 86400).cast("timestamp_ntz"))
        df.coalesce(2).write.parquet(f"{root}/{name}.parquet")

    save("orders", [(i, rng.choice([None, *range(30)]), "O", 1.0, 9000 + rng.randrange(200), "1") for i in range(120)], "o_orderdate")
    save("lineitem", [(rng.randrange(120), rng.randint(1, 4), rng.randrange(5), 1, 2.0, rng.choice([None, 5.5, -9.0]), 0.0, 0.1, "A", "O",
                       9000) for _ in range(400)], "l_shipdate")
    save("customer", [(i, "c", i % 2, 1.0, "x") for i in range(30)])
    save("nation", [(i, f"n{i}", 0) for i in range(2)])
    save("supplier", [(i, "s", i % 2, 1.0) for i in range(5)])
    save("part", [(i, "p", f"Brand#{i % 2}", "t", 1, 1.0) for i in range(1, 4)])
    return root


def test_quality_gates_read_facts_stored_in_columns(spark, rows, folder):
    study, plain = queries.Study(spark, folder), queries.Study(spark, folder)
    got = rows(queries._quality(study))
    for name in ("fact_orders", "cohort_retention"):
        stored = study.house.__dict__[name]
        assert stored.inputFiles() and all(f.endswith(".parquet") for f in stored.inputFiles())
        assert stored.columns == getattr(plain.house, name).columns
    assert got == rows(plain.house.quality_diagnostics) and {r[1] for r in got} == {"ok", "FAIL"}
