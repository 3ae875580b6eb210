"""Tests, identification checks, pooling and draws: published anchors, closed forms and identities."""

import math
from dataclasses import replace
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import distributions as dist
from bazaarlens.operators import abtest, draws, identification, mapfit, pooling


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_normal(spark):
    exact = NormalDist()
    for z in (-4.0, -1.5, 0.0, 0.7, 3.3):
        assert one(spark, dist.normal_cdf(F.lit(z)))[0] == pytest.approx(exact.cdf(z), abs=1e-7)


def test_log_gamma(spark):
    for x in (0.5, 1.0, 2.5, 40.0, 1e6):
        assert one(spark, dist.log_gamma(F.lit(x)))[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


def test_student(spark):
    # table values: two-sided 5% points
    for df, t in ((1, 12.7062), (4, 2.77645), (30, 2.04227), (1000, 1.96234)):
        p, critical = one(spark, dist.student_two_sided(F.lit(t), F.lit(float(df))), dist.student_critical(F.lit(float(df))))
        assert p == pytest.approx(0.05, abs=2e-6)
        assert critical == pytest.approx(t, rel=1e-4)
    assert one(spark, dist.student_two_sided(F.lit(0.0), F.lit(5.0)))[0] == pytest.approx(1.0)
    assert one(spark, dist.student_two_sided(F.lit(2.542), F.lit(12561.2)))[0] == pytest.approx(0.0110, abs=5e-5)


def test_chi_square_tail(spark):
    for df, x in ((1, 3.84146), (2, 5.99146), (3, 7.81473), (4, 9.48773), (31, 44.9853), (600, 658.094)):
        assert one(spark, dist.chi_square_upper(F.lit(x), F.lit(df)))[0] == pytest.approx(0.05, abs=2e-5)


def arm_table(spark, k1, n1, k0, n0):
    return spark.createDataFrame([(n1, k1, n0, k0)], "n_treated long, successes_treated long, n_control long, successes_control long")


def test_z_anchor(spark):
    row = abtest.two_proportion_z(arm_table(spark, 10784, 12279, 76652, 84998)).first()
    assert row.z == pytest.approx(-8.094, abs=1e-3)
    assert [100 * v for v in (row.diff, row.ci_low, row.ci_high)] == pytest.approx([-2.356, -2.968, -1.744], abs=1e-3)
    assert abtest.two_proportion_z(arm_table(spark, 80, 100, 50, 100)).first().z > 0


def test_welch_small(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0)] + [(0, v) for v in (2.0, 3.0, 4.0)], "treatment int, v double")
    row = abtest.welch_t(df, "v").first()
    assert (row.diff, row.df) == (pytest.approx(-1.0), pytest.approx(4.0))
    assert row.t == pytest.approx(-1.224745, abs=1e-6)
    assert row.p_value == pytest.approx(0.287864, abs=1e-5)
    assert (row.ci_low, row.ci_high) == (pytest.approx(-3.26696, abs=1e-4), pytest.approx(1.26696, abs=1e-4))


def test_mann_whitney_exact_and_ties(spark):
    a, b = [1.1, 2.2, 7.7], [3.3, 4.4, 5.5, 6.6]
    df = spark.createDataFrame([(1, v) for v in a] + [(0, v) for v in b], "treatment int, v double")
    row = abtest.mann_whitney(df, "v", rows_per_slice=2).first()
    ranks = sorted(a + b)
    u = sum(ranks.index(v) + 1 for v in a) - 6
    table = [sum(c) - 6 for c in combinations(range(1, 8), 3)]
    low = min(u, 12 - u)
    assert row.u_statistic == u
    assert row.p_value == pytest.approx(min(1.0, 2 * sum(t <= low for t in table) / len(table)))
    assert (row.median_treated, row.median_control) == (2.2, 4.95)
    tied = spark.createDataFrame([(1, 1.0)] * 4 + [(0, 1.0)] * 5, "treatment int, v double")
    assert tuple(abtest.mann_whitney(tied, "v").select("u_statistic", "p_value").first()) == (10.0, 1.0)


def contingency(spark, table):
    data = [(i, j + 1, n) for i, line in enumerate(table) for j, n in enumerate(line) if n]
    return spark.createDataFrame(data, "treatment int, review_score int, times int").select(
        "treatment", "review_score", F.explode(F.sequence(F.lit(1), "times"))
    )


def test_chi_square_anchor(spark):
    df = contingency(spark, [[7589, 2456, 6862, 16423, 48959], [1561, 415, 938, 2136, 6853]])
    row = abtest.chi_square(df, "treatment", "review_score").first()
    assert (row.df, row.chi2) == (4, pytest.approx(201.251, abs=1e-3))
    assert row.p_value < 1e-40


def test_chi_square_yates_and_empty_cell(spark):
    row = abtest.chi_square(contingency(spark, [[10, 20], [30, 40]]), "treatment", "review_score").first()
    assert row.chi2 == pytest.approx(0.446428, abs=1e-5)  # 100·(|10·40 − 20·30| − 50)² / (30·70·40·60)
    empty = abtest.chi_square(contingency(spark, [[0, 5, 5], [10, 5, 5]]), "treatment", "review_score").first()
    assert (empty.df, empty.chi2) == (2, pytest.approx(7.5))


def test_report_line(spark):
    line = one(spark, abtest.report_line(F.lit("x"), F.lit(0.5), F.lit(0.25), F.lit(0.75), F.lit(0.01)))[0]
    assert line == "x" + " " * 24 + "effect=+0.5000   95% CI=[+0.2500, +0.7500]   p=0.0100 *"


def test_saturated_did_matches_published_rates(spark):
    counts = spark.createDataFrame([(50, 100, 60, 100, 40, 100, 70, 100)], "k_00 long, n_00 long, k_01 long, n_01 long, k_10 long, n_10 long, k_11 long, n_11 long")
    row = identification.saturated_did(counts).first()
    logit = lambda p: math.log(p / (1 - p))
    assert row.did_logit == pytest.approx(logit(0.7) - logit(0.4) - logit(0.6) + logit(0.5))
    assert row.did_pp == pytest.approx(20.0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(50.0,), (299.99,), (300.0,), (300.01,), (49.99,), (None,)], "v double")
    got = {r.bin: r.n for r in identification.histogram(df, "v", 50.0, 300.0, 5.0).collect()}
    assert len(got) == 50 and got[0] == 1 and got[49] == 2 and got[25] == 0


def test_bunching(spark):
    sums = spark.createDataFrame([(2320, 1257.0, 702, 1180.0)], "observed_below int, predicted_below double, observed_above int, predicted_above double")
    row = identification.poisson_excess(sums).first()
    assert row.z == pytest.approx(-13.91, abs=0.01) and row.regime == "structural kink"
    cubic = spark.range(50).select(
        F.col("id").cast("int").alias("bin"), (F.col("id") * 5 + 52.5).alias("center")
    ).withColumn("n", F.lit(5000) - F.pow(F.log("center"), 3) * 20 + F.when(F.col("center") == 152.5, 900).otherwise(0))
    fitted = identification.bunching_fit(cubic, 150.0, 10.0)
    spike = identification.bunching_test(fitted, 150.0, 5.0).first()
    # the fixture has fractional counts, which the observed total truncates
    assert spike.excess == pytest.approx(900, abs=1.0) and spike.regime == "policy bunching"


def test_cost_benefit_anchor(spark):
    treated = spark.createDataFrame([(12405, 36.83, 381.95)], "n_orders int, avg_freight double, avg_payment double")
    logit = lambda p: math.log(p / (1 - p))
    effects = spark.createDataFrame([(logit(0.0264), logit(0.0281) - logit(0.0264), math.log(1.097))], "base_logit double, repeat_shift double, spend_shift double")
    row = identification.cost_benefit(treated, effects).first()
    assert row.subsidy == pytest.approx(456876, abs=1)
    assert row.net == pytest.approx(-452495, rel=1e-3)
    assert row.break_even_margin == pytest.approx(row.subsidy / row.incremental_gmv)


def effects_table(spark, data):
    return spark.createDataFrame(data, "category string, effect double, variance double")


def test_pooling_limits(spark):
    equal = effects_table(spark, [("a", 0.3, 0.1), ("b", 0.3, 0.2), ("c", 0.3, 0.4)])
    for r in pooling.partial_pool(equal).collect():
        assert (r.tau2, r.shrunk, r.mu) == (0.0, pytest.approx(0.3), pytest.approx(0.3)) and r.shrunk_sd > 0
    wide = effects_table(spark, [("a", -1.0, 0.1), ("b", 2.0, 0.2)])
    for r in pooling.partial_pool(wide, tau2=F.lit(1e9)).collect():
        assert r.shrunk == pytest.approx(r.effect, abs=1e-6)
    for r in pooling.partial_pool(wide, tau2=F.lit(0.0)).collect():
        assert r.shrunk == pytest.approx(r.mu)
    single = pooling.partial_pool(effects_table(spark, [("a", 0.5, 0.1)])).first()
    assert (single.shrunk, single.tau2) == (pytest.approx(0.5), 0.0)
    missing = pooling.partial_pool(effects_table(spark, [("a", 0.5, 0.1), ("b", None, None)])).where("category = 'b'").first()
    assert missing.shrunk == pytest.approx(0.5) and missing.shrunk_sd > 0


def test_did_logit_grain_does_not_matter(spark):
    coarse = spark.createDataFrame(
        [("a", 0, 0, 10, 5), ("a", 0, 1, 10, 6), ("a", 1, 0, 10, 4), ("a", 1, 1, 10, 8), ("b", 0, 0, 4, 4)],
        "category string, eligible int, post int, trials int, successes int",
    )
    halves = coarse.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "category", "eligible", "post",
        F.when(F.col("half") == 0, F.floor(F.col("trials") / 2)).otherwise(F.ceil(F.col("trials") / 2)).alias("trials"),
        F.when(F.col("half") == 0, F.floor(F.col("successes") / 2)).otherwise(F.ceil(F.col("successes") / 2)).alias("successes"),
    )
    a, b = (sorted(tuple(r) for r in pooling.category_did_logit(d).collect()) for d in (coarse, halves))
    assert [x[0] for x in a] == [x[0] for x in b]
    for x, y in zip(a, b):
        assert x[1:] == pytest.approx(y[1:])
    assert a[1][2] == pytest.approx(math.log(4.5 / 0.5))  # empty cells stay finite


def test_shortlist(spark):
    def table(values):
        return spark.createDataFrame(list(values.items()), "category string, shrunk double")

    favourable = {"x": table({"a": 3.0, "b": 2.0, "c": 1.0}), "y": table({"a": 1.0, "b": 3.0, "c": 0.0})}
    harmed = table({"a": -5.0, "d": -4.0, "b": 1.0, "c": 2.0})
    got = pooling.rollout_shortlist(favourable, harmed, n=2)  # a is among the two most harmed
    assert [(r.category, r.lists, r.outcomes) for r in got.collect()] == [("b", 2, "x,y")]


def test_bootstrap_is_repeatable_and_centred(spark):
    cells = spark.createDataFrame([("a", e, p, 400, 300) for e in (0, 1) for p in (0, 1)], "category string, eligible int, post int, trials int, successes int")
    first = draws.bootstrap_effects(cells, 400, seed=5)
    assert first.exceptAll(draws.bootstrap_effects(cells.repartition(3), 400, seed=5)).count() == 0
    row = draws.summarise_draws(first).first()
    expected_sd = math.sqrt(4 * (1 / 300 + 1 / 100))
    assert row.n_samples == 400 and abs(row["mean"]) < 3 * expected_sd / 20
    assert row.sd == pytest.approx(expected_sd, rel=0.15)
    small = draws.bootstrap_counts(spark.createDataFrame([("k", 3)], "c string, n int"), ["c"], ["n"], 2000)
    mean, variance = small.agg(F.avg("n"), F.var_samp("n")).first()
    assert mean == pytest.approx(3, abs=0.15) and variance == pytest.approx(3, rel=0.15)


def chain_table(spark, value):
    return spark.range(400).select(
        F.lit("p").alias("param"), F.lit("c").alias("category"), (F.col("id") % 4).cast("int").alias("chain"),
        F.floor(F.col("id") / 4).cast("int").alias("draw"), value.alias("value"),
    )


def test_draw_diagnostics(spark):
    noise = chain_table(spark, F.hash("id").cast("double") / 2147483648.0)
    assert draws.rhat(noise).first().rhat == pytest.approx(1.0, abs=0.05)
    assert 250 < draws.ess(noise).first().ess < 1500
    split = noise.withColumn("value", F.col("value") + F.col("chain") * 10)
    assert draws.rhat(split).first().rhat > 3
    assert draws.ess(split).first().ess < 20
    skewed = chain_table(spark, F.pow(F.col("id").cast("double"), 2.0))
    row = draws.hdi(skewed, 0.5, rows_per_slice=11).first()
    assert (row.hdi_low, row.hdi_high) == (0.0, 200.0**2)


def test_information_criteria(spark):
    cells = spark.createDataFrame([(c, e, p, 50, 20 + e + p) for c in "ab" for e in (0, 1) for p in (0, 1)], "category string, eligible int, post int, trials int, successes int")
    loglik = draws.binomial_loglik(cells, draws.bootstrap_cells(cells, 200), "m").persist()
    w, t, s = draws.waic(loglik).first(), draws.loo_truncated(loglik).first(), draws.loo_smoothed(loglik).first()
    assert w.n_cells == 8 and w.elpd_waic < w.lppd and w.p_waic > 0
    assert t.elpd_loo == pytest.approx(w.elpd_waic, abs=2.0) and s.elpd_loo == pytest.approx(t.elpd_loo, abs=2.0)
    assert s.worst_pareto_k < 1.5
    constant = loglik.withColumn("loglik", F.lit(-2.0))
    flat = draws.loo_smoothed(constant).first()
    assert (flat.elpd_loo, draws.waic(constant).first().elpd_waic) == (pytest.approx(-16.0), pytest.approx(-16.0))
    other = draws.waic(loglik.where("cell like 'a%'").withColumn("model", F.lit("n")))
    with pytest.raises(ValueError, match="different cells"):
        draws.rank_models(draws.waic(loglik).unionByName(other), "elpd_waic")


# ---------------------------------------------------------------- MAP recovery ------
def simulated(spark, shifts):
    """Expected counts of a known logistic model: no sampling noise."""
    data = []
    for c, shift in enumerate(shifts):
        for tier in range(3):
            for e in (0, 1):
                for p in (0, 1):
                    eta = 0.4 + 0.2 * (c % 3) - 0.6 * e + 0.3 * p + (0.5 + shift) * e * p + 0.1 * (tier - 1)
                    n = 40000
                    data.append((f"c{c}", f"t{tier}", "s", e, p, n, round(n / (1 + math.exp(-eta)))))
    cells = spark.createDataFrame(data, "category string, tier string, state string, eligible int, post int, trials long, successes long")
    return mapfit.with_policy(cells)


def check_certificate(cells, model, fit):
    """Every coefficient explains its total; the table of parameters is complete."""
    rows = mapfit.certificate(cells, model, fit).collect()
    assert fit.converged and len(rows) == fit.coefficients.count() + max(len(fit.cutpoints) - 1, 0)
    assert all(r.explained == pytest.approx(r.observed, abs=1e-4, rel=1e-9) for r in rows), rows
    assert any(r.observed for r in rows)
    kinds = {r["kind"]: r["count"] for r in fit.parameters.groupBy("kind").count().collect()}
    assert kinds["coefficient"] == fit.coefficients.count() and kinds["scale"] == len(fit.scales)
    assert kinds.get("cutpoint", 0) == len(fit.cutpoints)


def test_certificate_fails_away_from_the_optimum(spark):
    cells = simulated(spark, [-0.3, 0.3])
    fit = mapfit.map_fit(cells, mapfit.BINOMIAL_DID)
    moved = replace(fit, coefficients=fit.coefficients.withColumn("estimate", F.col("estimate") + F.when(F.col("term") == "post", 0.01).otherwise(0.0)))
    rows = {(r.term, r.label): r for r in mapfit.certificate(cells, mapfit.BINOMIAL_DID, moved).collect()}
    assert abs(rows[("post", None)].explained - rows[("post", None)].observed) > 100


def test_cells_without_a_label_take_no_part(spark):
    cells = simulated(spark, [-0.3, 0.3])
    holes = cells.withColumn("category", F.lit(None).cast("string")).unionByName(cells)
    fits = [mapfit.map_fit(c, mapfit.BINOMIAL_DID) for c in (cells, holes)]
    assert fits[0].objective == pytest.approx(fits[1].objective)
    with pytest.raises(ValueError, match="no complete cell"):
        mapfit.map_fit(cells.limit(0), mapfit.BINOMIAL_DID)


def test_unconverged_fits_say_so(spark):
    fit = mapfit.map_fit(simulated(spark, [-0.3, 0.3]), mapfit.BINOMIAL_DID, max_steps=1)
    assert not fit.converged and not fit.parameters.where("converged").count()


def test_map_recovers_binomial_did(spark):
    shifts = [-0.3, 0.3, -0.1, 0.1, -0.2, 0.2]
    fit = mapfit.map_fit(simulated(spark, shifts), mapfit.BINOMIAL_DID)
    check_certificate(simulated(spark, shifts), mapfit.BINOMIAL_DID, fit)
    got = {(r.term, r.label): r for r in fit.coefficients.collect()}
    assert got[("eligible", None)].estimate == pytest.approx(-0.6, abs=0.03)
    assert got[("post", None)].estimate == pytest.approx(0.3, abs=0.03)
    for c, shift in enumerate(shifts):
        row = got[("delta", f"c{c}")]
        assert row.estimate == pytest.approx(0.5 + shift, abs=3 * row.sd + 0.01) and 0 < row.sd < 0.1
    assert 0.1 < fit.scales["delta"] < 0.5 and fit.steps < mapfit.MAX_STEPS
    pooled = {r.category: r.shrunk for r in pooling.partial_pool(pooling.category_did_logit(simulated(spark, shifts))).collect()}
    assert all(pooled[f"c{c}"] == pytest.approx(got[("delta", f"c{c}")].estimate, abs=0.05) for c in range(6))


def test_map_recovers_spend(spark):
    base = spark.range(6000).select(
        F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("category"),
        (F.floor(F.col("id") / 4) % 2).cast("int").alias("eligible"), (F.floor(F.col("id") / 8) % 2).cast("int").alias("post"),
        (F.hash("id") / 2147483648.0 + 4.5).alias("log_first_subtotal"), (F.hash("id", F.lit(1)) / 2147483648.0).alias("noise"),
    )
    y = 2.0 + 0.3 * F.col("eligible") - 0.2 * F.col("post") + 0.4 * F.col("eligible") * F.col("post") + 0.6 * F.col("log_first_subtotal") + F.col("noise") * 0.5
    cells = mapfit.with_policy(mapfit.gaussian_cells(base, y, F.col("log_first_subtotal"), {"category": "category"}, ["eligible", "post"]))
    fit = mapfit.map_fit(cells, mapfit.SPEND_DID)
    check_certificate(cells, mapfit.SPEND_DID, fit)
    got = {(r.term, r.label): r.estimate for r in fit.coefficients.collect()}
    assert got[("log_first_subtotal", None)] == pytest.approx(0.6, abs=0.05)
    assert got[("delta_bar", None)] == pytest.approx(0.4, abs=0.1)
    assert fit.scales["observation"] == pytest.approx(0.5 / math.sqrt(3), rel=0.05)


def test_map_recovers_ordinal(spark):
    cuts, data = [0.0, 0.7, 1.5, 2.2], []
    for c in range(4):
        for e in (0, 1):
            for p in (0, 1):
                eta = 1.2 + 0.1 * c - 0.3 * e + 0.2 * p - 0.5 * e * p
                below = [1 / (1 + math.exp(eta - k)) for k in cuts] + [1.0]
                levels = [round(20000 * (b - a)) for a, b in zip([0.0, *below], below)]
                data.append((f"c{c}", "t", e, p, *levels))
    columns = "category string, tier string, eligible int, post int, " + ", ".join(f"level_{k} long" for k in range(5))
    cells = mapfit.with_policy(spark.createDataFrame(data, columns))
    fit = mapfit.map_fit(cells, mapfit.REVIEW_DID)
    check_certificate(cells, mapfit.REVIEW_DID, fit)
    got = {(r.term, r.label): r.estimate for r in fit.coefficients.collect()}
    assert fit.cutpoints == pytest.approx(cuts, abs=0.03) and fit.cutpoints[0] == 0.0
    assert got[("delta_bar", None)] == pytest.approx(-0.5, abs=0.05)
    assert got[("eligible", None)] == pytest.approx(-0.3, abs=0.05)


def test_rank_counts_by_enumeration_and_for_a_large_arm():
    for small, large in ((1, 4), (2, 5), (3, 6), (5, 7)):
        sums = [sum(c) - small * (small - 1) // 2 for c in combinations(range(small + large), small)]
        for u in range(small * large + 1):
            assert abtest.lower_rank_count(small, large, u) == sum(s <= u for s in sums)
    # by symmetry all arrangements lie at or below the largest value
    assert abtest.lower_rank_count(7, 300_000, 7 * 300_000) == math.comb(300_007, 7)


@pytest.mark.parametrize("mean", [0.0, 5.0, 30.0, 31.0, 1e4, 1e8])
def test_poisson_draws_have_the_right_law(mean):
    u = (np.arange(200_000) + 0.5) / 200_000
    k = draws.poisson_quantiles(mean, u)
    assert k.mean() == pytest.approx(mean, rel=1e-3)
    assert k.var() == pytest.approx(mean, rel=1e-2)
    if mean:
        skewness = ((k - k.mean()) ** 3).mean() / k.std() ** 3
        assert skewness == pytest.approx(mean**-0.5, abs=5e-3)


def test_poisson_draws_have_the_right_tails():
    def below(k, mean):
        return sum(math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) for j in range(k + 1))

    for mean, low, high in ((5.0, 0, 14), (30.0, 14, 49), (31.0, 19, 45), (1e4, 9_700, 10_300)):
        for k in (low, high):
            p = below(k, mean)
            assert draws.poisson_quantiles(mean, np.array([p * (1 - 1e-9), min(p + (1 - p) * 1e-6, 1.0)])).tolist() == [k, k + 1]


def test_tails_do_not_depend_on_a_size_limit(spark):
    for df in (1.0, 30.5, 200.0, 201.0, 19_999.0, 20_001.0, 1e9):
        p = one(spark, dist.student_two_sided(dist.student_critical(F.lit(df)), F.lit(df)))[0]
        assert p == pytest.approx(0.05, abs=1e-9)
    near, far = one(spark, dist.student_two_sided(F.lit(9.0), F.lit(20_000.0)), dist.student_two_sided(F.lit(9.0), F.lit(20_000.5)))
    assert near == pytest.approx(far, rel=1e-4) and 0 < far < near
    points = [one(spark, dist.chi_square_upper(F.lit(1.2 * df), F.lit(df)))[0] for df in (399, 400, 401, 402)]
    assert all(0.95 < b / a < 1.0 for a, b in zip(points, points[1:]))
    # e^-h (1 + h) for four degrees of freedom
    assert one(spark, dist.chi_square_upper(F.lit(200.0), F.lit(4)))[0] == pytest.approx(math.exp(-100.0) * 101.0, rel=1e-9)
    assert one(spark, dist.chi_square_upper(F.lit(100.0), F.lit(50_000)))[0] == pytest.approx(1.0)
    assert one(spark, dist.chi_square_upper(F.lit(0.0), F.lit(3)), dist.chi_square_upper(F.lit(None).cast("double"), F.lit(3))) == (1.0, None)
