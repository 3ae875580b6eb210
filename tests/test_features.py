"""Treatment rule, frames, panels and sampling."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import features
from bazaarlens.operators.features import TreatmentSpec

TOY = list(zip(
    ["2017-06-01", "2017-06-01", "2017-12-01", "2017-12-01", "2018-02-01", "2018-02-01", "2018-06-01", "2018-06-01"],
    [50.0, 200.0, 80.0, 300.0, 150.0, 149.99, 0.0, 500.0],
))
SPEC = TreatmentSpec(threshold=150.0, cutover=date(2018, 1, 1))


@pytest.fixture()
def toy(spark):
    return spark.createDataFrame(TOY, "week string, items_subtotal double").select(
        F.col("week").cast("date").alias("purchase_week"), "items_subtotal"
    )


def test_needs_a_cutover():
    with pytest.raises(ValueError, match="cutover"):
        TreatmentSpec().assign()


def test_treated_iff_post_and_at_threshold(toy):
    got = {(str(r[0]), r[1]): r[2] for r in toy.select("*", SPEC.assign()).collect()}
    assert [got[row] for row in TOY] == [0, 0, 0, 0, 1, 0, 0, 1]


def test_never_below_threshold_nor_before_cutover(toy):
    out = toy.withColumn("t", SPEC.assign())
    assert out.where("t = 1 and items_subtotal < 150").count() == 0
    assert out.where("t = 1 and purchase_week < date'2018-01-01'").count() == 0


def test_nan_and_null_are_untreated(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "items_subtotal double").withColumn(
        "purchase_week", F.lit("2018-03-01").cast("date")
    )
    assert [r[0] for r in df.select(SPEC.assign()).collect()] == [0, 0]
    always = replace(SPEC, threshold=0.0)
    assert [r[0] for r in df.select(always.assign()).collect()] == [1, 1]


def covariates(spark):
    data = [
        (1, "2018-01-01", "b", "small", "SP", 1, True, True, 200.0),
        (2, "2018-01-08", "a", "small", "SP", 1, True, False, 100.0),
        (3, "2018-01-15", "a", "large", "RJ", 1, False, None, None),
        (4, "2018-01-22", "a", "large", "RJ", 2, True, True, 300.0),
        (5, "2018-01-22", None, "large", "RJ", 2, True, True, 300.0),
        (6, "2018-01-22", "a", None, "RJ", 2, True, True, 300.0),
        (7, "2018-03-12", "a", "large", "RJ", 3, True, True, 300.0),
    ]
    return spark.createDataFrame(
        data, "order_id int, w string, category_en string, seller_volume_tier string, customer_state string,"
        "calendar_month int, is_delivered boolean, is_on_time boolean, items_subtotal double",
    ).withColumn("purchase_week", F.col("w").cast("date"))


def test_modelling_frame(spark):
    frame, spec = features.modelling_frame(covariates(spark))
    got = {r.order_id: r for r in frame.collect()}
    # week 7 falls to the grace cut-off; 5 and 6 lack variables; the median week lies between 2 and 3
    assert sorted(got) == [1, 2, 3, 4]
    assert [got[i].post for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
    assert [got[i].treatment for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [got[i].category_en_code for i in (1, 2)] == [1, 0]
    kept, _ = features.modelling_frame(covariates(spark), drop_missing_category=False)
    assert {r.order_id: r.category_en_code for r in kept.collect()}[5] == -1


def test_panels_keep_every_order(spark):
    frame, _ = features.modelling_frame(covariates(spark))
    for panel in (features.panel_naive(frame), features.panel_did(frame)):
        sums = panel.agg(F.sum("n_orders"), F.sum("n_delivered"), F.sum("n_on_time")).first()
        assert tuple(sums) == (4, 3, 2)
    did = features.panel_did(frame)
    assert features.select_outcome(did, features.DID_COLUMNS, "n_delivered").agg(F.sum("successes")).first()[0] == 3
    with pytest.raises(ValueError, match="n_lost"):
        features.select_outcome(did, features.DID_COLUMNS, "n_lost")
    with pytest.raises(ValueError, match="n_orders"):
        features.select_outcome(did.drop("n_orders"), features.DID_COLUMNS)


def test_keep_frequent(spark, rows):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)] * 4, "c string")
    assert rows(features.keep_frequent(df, "c", 3)) == [("a",)] * 3


@pytest.mark.parametrize("rows_per_slice", [7, 10**6])
def test_stratified_sample_is_exact(spark, rows_per_slice):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "big").when(F.col("id") < 999, "mid").otherwise("one"))
    got = features.stratified_sample(df, "g", "id", 100, rows_per_slice=rows_per_slice)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"big": 70, "mid": 29, "one": 1}
    assert features.stratified_sample(df, "g", "id", 100, at_least=0).where("g = 'one'").count() == 0
    assert features.stratified_sample(df, "g", "id", 0).count() == 1000
    assert features.stratified_sample(df, "g", "id", 1000).count() == 1000
    again = features.stratified_sample(df, "g", "id", 100, seed=1)
    assert again.exceptAll(got).count() > 0


def test_value_profile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,), (None,)], "v double")
    assert tuple(features.value_profile(df, "v", rows_per_slice=2).first()) == (4, 1.0, 10.0, 2.0)
