"""Sliced windows, tiles and prefixes against Spark's own single-task windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaarlens.operators import analytics, ordered


def skewed(spark, n=4000):
    """One key holds a third of the rows, another key is NULL; timestamps tie a lot."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("id"),
        F.when(i % 3 == 0, F.lit(7)).when(i % 17 == 0, F.lit(None)).otherwise(i % 40).cast("int").alias("k"),
        F.timestamp_seconds((i * 7919 % 900) * 86400).cast("timestamp_ntz").alias("ts"),
        F.when(i % 11 != 0, (i * 31 % 101).cast("double")).alias("v"),
    )


@pytest.mark.parametrize("rows_per_slice", [13, 10**6])
def test_group_sequence_equals_window(spark, rows_per_slice):
    df = skewed(spark)
    got = ordered.group_sequence(
        df, ["k"], ["ts", "id"], rank="r", total="n", previous={"ts": "p"}, first={"v": "f"},
        rows_per_slice=rows_per_slice,
    )
    whole = Window.partitionBy("k")
    line = whole.orderBy("ts", "id")
    want = df.select(
        "*", F.row_number().over(line).cast("bigint").alias("r"), F.count("*").over(whole).alias("n"),
        F.lag("ts").over(line).alias("p"), F.first("v").over(line).alias("f"),
    )
    assert got.count() == df.count()
    assert got.exceptAll(want).count() == 0


def test_hot_group_is_cut_into_slices(spark):
    df = skewed(spark)
    sliced = ordered.slice_groups(df, ["k"], ["ts", "id"], rows_per_slice=50)
    sizes = sliced.groupBy("k", "__slice").count().where("k = 7")
    assert sizes.count() > 10
    assert sizes.agg(F.max("count")).first()[0] < 700


@pytest.mark.parametrize("rows_per_slice", [13, 10**6])
def test_sessions_equal_window(spark, rows_per_slice):
    df = skewed(spark).select("id", "k", "ts")
    got = analytics.sessionize(df, ["k"], "ts", "id", gap_days=2, rows_per_slice=rows_per_slice)
    line = Window.partitionBy("k").orderBy("ts", "id")
    flagged = df.withColumn("d", F.datediff("ts", F.lag("ts").over(line)).cast("bigint")).withColumn(
        "o", F.when(F.col("d").isNull() | (F.col("d") > 2), 1).otherwise(0)
    )
    ided = flagged.withColumn("s", F.sum("o").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.row_number().over(Window.partitionBy("k", "s").orderBy("ts", "id")).cast("bigint")
    want = ided.select("id", "k", "ts", "d", "s", rank.alias("r")).withColumn("first", F.col("r") == 1)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("n", [1, 3, 6, 7, 1000])
@pytest.mark.parametrize("rows_per_slice", [5, 10**6])
def test_ntile_equals_window(spark, n, rows_per_slice):
    df = skewed(spark, n).select("id", "v")
    got = ordered.distributed_ntile(df, ["v", "id"], 4, rows_per_slice=rows_per_slice)
    order = Window.orderBy(F.asc_nulls_last("v"), "id")
    want = df.select("*", F.ntile(4).over(order).cast("bigint").alias("tile"))
    assert got.exceptAll(want).count() == 0 and got.count() == n


def test_prefix_sums_and_totals(spark):
    df = skewed(spark, 500).select("id")
    got = ordered.global_prefix(df, ["id"], {"before": F.col("id")}, totals={"before": "total"}, rows_per_slice=9)
    for row in got.collect():
        assert row.before == row.id * (row.id - 1) // 2 and row.total == 500 * 499 // 2


def test_midranks_and_medians(spark):
    pdf = [(float(v), a) for v, a in [(1, 1), (2, 0), (2, 1), (2, 0), (5, 1), (7, 0), (7, 0)]]
    df = spark.createDataFrame(pdf, "v double, arm int")
    ranked = ordered.ranked_values(ordered.value_counts(df, "v", "arm"), rows_per_slice=2)
    assert {r.value: r.midrank for r in ranked.collect()} == {1.0: 1.0, 2.0: 3.0, 5.0: 5.0, 7.0: 6.5}
    medians = ranked.agg(
        ordered.median_of_counts("value", "n1", "below1", "total1").alias("m1"),
        ordered.median_of_counts("value", "n0", "below0", "total0").alias("m0"),
    ).first()
    assert (medians.m1, medians.m0) == (2.0, 4.5)


def test_no_exchange_carries_cut_points(spark):
    """What is shuffled for sessions is rows and flags, never an array."""
    df = skewed(spark).select("id", "k", "ts")
    got = analytics.sessionize(df, ["k"], "ts", "id", gap_days=2, rows_per_slice=13)
    node = got._jdf.queryExecution().executedPlan()
    plans = [node]
    wide = []
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "Exchange":
            wide.append(plan.schema().catalogString())
        if name == "AdaptiveSparkPlan":
            plans.append(plan.initialPlan())
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    # the sampled cut points themselves are grouped once; the rows of the table are not among them
    assert wide and all("array" not in schema for schema in wide if "id:" in schema)
