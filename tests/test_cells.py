"""Cell table, label dictionaries, watched gates, predictive limits and model comparison."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from bazaarlens.operators import abtest, draws, features, identification, pooling, quality
from bazaarlens.operators.features import TreatmentSpec


def order_rows(spark, n=4000):
    k = F.col("id")
    return spark.range(n).select(
        k.alias("order_id"), F.date_add(F.lit("2018-01-01").cast("date"), (k % 30).cast("int") * 7).alias("purchase_week"),
        F.concat(F.lit("c"), (k % 5).cast("string")).alias("category_en"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("seller_volume_tier"),
        F.concat(F.lit("s"), (k % 7).cast("string")).alias("customer_state"), (k % 12 + 1).cast("int").alias("calendar_month"),
        (F.pmod(F.xxhash64("id"), F.lit(400)) + 0.25).alias("items_subtotal"), (k % 9 != 0).alias("is_delivered"),
        F.when(k % 11 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(4)) != 0).alias("is_on_time"),
    )


def test_cells_answer_what_rows_answer(spark, rows):
    orders, spec = order_rows(spark), TreatmentSpec(threshold=150.0)
    cells = features.modelling_cells(orders, spec)
    by_rows, by_cells = features.finalise_spec(orders, spec), features.finalise_spec(cells, spec, weight="n_orders")
    wide = features.with_treatment(orders.withColumn("eligible", spec.eligible()), by_rows)
    small = features.with_treatment(cells, by_cells)
    w = dict(weight="n_orders")
    assert rows(abtest.arm_counts(wide, "is_on_time")) == rows(abtest.arm_counts(small, "n_on_time", **w))
    assert rows(identification.cell_counts(wide, F.col("is_on_time"))) == rows(identification.cell_counts(small, F.col("n_on_time"), **w))
    assert rows(features.cell_summary(wide)) == rows(features.cell_summary(small, success="n_on_time", **w))
    assert rows(pooling.outcome_cells(wide, "category_en", F.col("is_on_time"))) == rows(
        pooling.outcome_cells(small, "category_en", F.col("n_on_time"), **w))
    for panel in (features.panel_did, features.panel_naive):
        encoded = [features.encode_labels(df) for df in (wide, small)]
        one, two = (panel(df).withColumn("avg_subtotal", F.round("avg_subtotal", 6)) for df in encoded)
        assert rows(one) == rows(two)
    assert cells.count() < orders.count()


def test_dictionary_of_many_labels(spark):
    df = spark.range(300_000).select(F.concat(F.lit("label "), F.md5(F.col("id").cast("string"))).alias("x"))
    codes = features.label_dictionary(df.unionAll(df.limit(1000)), "x", rows_per_slice=20_000)
    found = codes.agg(F.count("*"), F.min("code"), F.max("code"), F.count_distinct("code")).first()
    assert tuple(found) == (300_000, 0, 299_999, 300_000)
    ordered = [r.label for r in codes.where("code < 1000").orderBy("code").collect()]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("broadcast_labels", [0, 100])
def test_hot_labels_keep_their_rows(spark, rows, broadcast_labels):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 3 == 2, F.concat(F.lit("l"), (F.col("id") % 40).cast("string"))).alias("x"))
    df = df.unionByName(spark.createDataFrame([(-1, None), (-1, None)], "id long, x string"))
    dictionary = features.label_dictionary(df, "x")
    got = features.attach_codes(df, dictionary, "x", "code", broadcast_labels=broadcast_labels, salts=4)
    names = sorted({r.x for r in df.collect() if r.x is not None})
    want = sorted(((r.id, r.x, None if r.x is None else names.index(r.x)) for r in df.collect()), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    plan = got._jdf.queryExecution().toString()
    assert ("Broadcast" in plan.split("== Physical Plan ==")[1]) == (broadcast_labels > 0) or broadcast_labels == 0


def test_cell_queries_store_no_rows(spark, monkeypatch):
    """What is stored for the headline tests is cells: far fewer than the orders behind them."""
    from bazaarlens.plans import queries as plans

    stored = []
    keep = plans.cut_lineage
    monkeypatch.setattr(plans, "cut_lineage", lambda df: stored.append(df.columns) or keep(df))
    plans.QUERIES["did_saturated"](spark, "/root/testdata/sf0.001").collect()
    assert stored and all("order_id" not in columns for columns in stored)


def test_required_columns_are_named():
    class Panel:
        columns = ["a"]

    features.require_columns(Panel, ["a"])
    with pytest.raises(ValueError, match="b"):
        features.require_columns(Panel, ["a", "b"])


# ---- watched gates ----------------------------------------------------------------------
def test_gates_are_counted_while_a_table_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (-2.0,), (None,), (0.5,)], "v double")
    gates = {"v in [0,1]": ("v", 0.0, 1.0), "v >= 0": ("v", 0.0, None), "v <= 0.4": ("v", None, 0.4)}
    watched, seen = quality.watch(df, gates)
    watched.write.parquet(str(tmp_path / "t"))
    counts = quality.watched_counts(seen, gates)
    assert counts == {"v in [0,1]": 1, "v >= 0": 1, "v <= 0.4": 2} and seen.get["rows"] == 4
    checks = {r.check_name: (r.status, r.observed) for r in quality.watched_checks(spark, {**counts, "none": 0}).collect()}
    assert checks["v >= 0"] == ("FAIL", "1") and checks["none"] == ("ok", "0")
    by_scan = {r.check_name: (r.status, r.observed) for r in quality.range_check(df, "v", "v in [0,1]", 0.0, 1.0).collect()}
    assert by_scan["v in [0,1]"] == checks["v in [0,1]"]


# ---- predictive limits --------------------------------------------------------------------
def effect_cells(spark, shifts):
    data = []
    for c, shift in enumerate(shifts):
        for e in (0, 1):
            for p in (0, 1):
                eta = 0.4 - 0.6 * e + 0.3 * p + (0.5 + shift) * e * p
                data.append((f"c{c:02d}", e, p, 4000, round(4000 / (1 + math.exp(-eta)))))
    return spark.createDataFrame(data, "category string, eligible int, post int, trials long, successes long")


def test_a_planted_misfit_is_checked(spark):
    shifts = [0.02 * (-1) ** c for c in range(30)]
    cells = effect_cells(spark, shifts)

    def verdicts(df):
        pooled = pooling.partial_pool(pooling.category_did_logit(df))
        return {r.category: r for r in pooling.predictive_limits(pooled, pooling.treated_level(df)).collect()}

    good = verdicts(cells)
    assert {r.verdict for r in good.values()} == {"GOOD"} and all(r.low < r.observed < r.high for r in good.values())
    bad = verdicts(effect_cells(spark, [1.5, *shifts[1:]]))
    assert bad["c00"].verdict == "CHECK" and bad["c00"].observed > bad["c00"].high
    assert sum(r.verdict == "CHECK" for r in bad.values()) == 1


# ---- model comparison ----------------------------------------------------------------------
def test_left_out_densities_equal_refits(spark):
    rng = np.random.default_rng(1)
    data = [(f"w{w}", f"c{c}", e, p, e * p, int(n), int(rng.binomial(n, 0.5 + 0.2 * e * p + 0.1 * c)))
            for w in range(6) for c in range(2) for e in (0, 1) for p in (0, 1) for n in [rng.integers(1, 60)]]
    cells = spark.createDataFrame(data, "week string, category string, eligible int, post int, treatment int, trials long, successes long")
    models = {"naive": ["category", "treatment"], "did": ["category", "eligible", "post"]}
    keys = ["week", "category", "eligible", "post"]
    pointwise = draws.cell_elpd(cells, models, keys)
    found = {(r.model, *[r[k] for k in keys]): r.elpd for r in pointwise.collect()}
    at = {"naive": (1, 4), "did": (1, 2, 3)}
    want = {}
    for model, columns in at.items():
        for row in data:
            others = [o for o in data if o is not row and all(o[c] == row[c] for c in columns)]
            p = (sum(o[6] for o in others) + 0.5) / (sum(o[5] for o in others) + 1.0)
            n, k = row[5], row[6]
            want[(model, *row[:4])] = math.log(math.comb(n, k)) + k * math.log(p) + (n - k) * math.log1p(-p)
    assert found.keys() == want.keys() and all(found[c] == pytest.approx(want[c], abs=1e-6) for c in want)
    ranked = {r.model: r for r in draws.compare_models(pointwise, keys).collect()}
    gaps = [want[("naive", *r[:4])] - want[("did", *r[:4])] for r in data]
    worse = min(ranked.values(), key=lambda r: r.elpd)
    assert {r.rank for r in ranked.values()} == {1, 2} and max(r.difference for r in ranked.values()) == 0
    assert abs(worse.difference) == pytest.approx(abs(sum(gaps)), abs=1e-6)
    assert worse.difference_se == pytest.approx(math.sqrt(len(gaps)) * np.std(gaps), abs=1e-6)
    with pytest.raises(ValueError, match="different cells"):
        draws.compare_models(pointwise.where("model = 'did' OR week > 'w0'"), keys)


def test_new_queries_have_twins():
    names = ["predictive_limits", "predictive_limits_hurdle", "predictive_limits_scores", "model_comparison"]
    names += [n for n in registry.queries() if n.startswith("map_certificate")]
    assert len(names) == 10 and set(names) <= set(registry.oracle_sql())
