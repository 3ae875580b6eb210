"""Identification checks for the policy effect, and its cost-benefit sizing."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import distributions as dist
from bazaarlens.functions import expressions as ex

# ---- fixed values -----------------------------------------------------------------
SIGNIFICANT_Z = 1.96
INCREMENTAL_MARGIN = 0.20
VERDICT_PARALLEL = "consistent with parallel trends"
VERDICT_VIOLATED = "parallel trends violated"
# -----------------------------------------------------------------------------------
CELLS = {"00": (0, 0), "01": (0, 1), "10": (1, 0), "11": (1, 1)}


def pre_period(weekly: DataFrame, cutover_day: Column) -> DataFrame:
    """Weeks before the cutover with `t`, the weeks since the first of them."""
    before = weekly.withColumn("__cut", cutover_day).where(
        F.unix_date("purchase_week").cast("double") < F.col("__cut")
    ).drop("__cut")
    start = before.agg(F.min("purchase_week")).scalar()
    return before.withColumn("__start", start).withColumn(
        "t", F.datediff("purchase_week", "__start") / F.lit(7.0)
    ).drop("__start")


def pre_trend_test(pre: DataFrame) -> DataFrame:
    """Grouped-binomial regression on_time ~ t + eligible + t·eligible; one row per coefficient.

    The cells (one per week and eligibility) are fitted by Spark's GLM, weighted by trials.
    """
    side = F.col("eligible").cast("int").cast("double")
    cells = pre.select(
        F.col("n").cast("double").alias("n"), "rate",
        F.col("t"), side.alias("eligible"), (F.col("t") * side).alias("t_x_eligible"),
    )
    names = ["t", "eligible", "t_x_eligible"]
    design = VectorAssembler(inputCols=names, outputCol="features").transform(cells)
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="rate", weightCol="n", featuresCol="features",
        tol=1e-12, maxIter=50,
    )
    model = glm.fit(design)
    summary = model.summary
    spark = pre.sparkSession
    # Spark lists the intercept last in its error columns
    values = zip(
        [*names, "const"], [*model.coefficients.toArray().tolist(), float(model.intercept)],
        summary.coefficientStandardErrors, summary.pValues,
    )
    rows = [(n, float(c), float(s), float(p)) for n, c, s, p in values]
    fitted = spark.createDataFrame(rows, "coefficient string, estimate double, se double, p_value double")
    tested = F.when(
        F.col("coefficient") == "t_x_eligible",
        F.when(F.col("p_value") >= 0.05, VERDICT_PARALLEL).otherwise(VERDICT_VIOLATED),
    )
    return fitted.withColumns(
        {
            "aic": F.lit(float(summary.aic)),
            "df_resid": F.lit(int(summary.residualDegreeOfFreedom)),
            "verdict": tested,
        }
    )


def cell_counts(df: DataFrame, success: Column, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Successes `k_ep` and trials `n_ep` of the four (eligible, post) cells, wide.

    `df` holds rows with a flag, or finer cells with `weight` rows and `success` successes.
    """
    trials, hits = ex.tally(success, weight)
    aggregates = []
    for name, (e, p) in CELLS.items():
        here = (F.col("eligible") == e) & (F.col("post") == p)
        aggregates += [ex.total(hits, here).alias(f"k_{name}"), ex.total(trials, here).alias(f"n_{name}")]
    return df.groupBy(*keys).agg(*aggregates)


def saturated_did(counts: DataFrame) -> DataFrame:
    """Closed-form 2×2 difference-in-differences from `cell_counts`.

    Percentage-point difference and log-odds interaction; SE = √Σ(1/k + 1/(n−k)).
    """
    rate = {c: ex.safe_ratio(f"k_{c}", f"n_{c}") for c in CELLS}
    logit = {c: F.ln(F.try_divide(F.col(f"k_{c}").cast("double"), (F.col(f"n_{c}") - F.col(f"k_{c}")).cast("double"))) for c in CELLS}
    parts = [
        F.try_divide(F.lit(1.0), F.col(f"k_{c}").cast("double"))
        + F.try_divide(F.lit(1.0), (F.col(f"n_{c}") - F.col(f"k_{c}")).cast("double"))
        for c in CELLS
    ]
    variance = parts[0] + parts[1] + parts[2] + parts[3]
    sized = counts.select(
        "*", *[rate[c].alias(f"rate_{c}") for c in CELLS],
        logit["00"].alias("alpha"),
        (logit["10"] - logit["00"]).alias("beta_eligible"),
        (logit["01"] - logit["00"]).alias("beta_post"),
        (logit["11"] - logit["10"] - logit["01"] + logit["00"]).alias("did_logit"),
        F.sqrt(variance).alias("did_se"),
    )
    z = F.try_divide(F.col("did_logit"), F.col("did_se"))
    return sized.select(
        "*",
        ((F.col("rate_11") - F.col("rate_10") - F.col("rate_01") + F.col("rate_00")) * 100.0).alias("did_pp"),
        z.alias("z"), dist.normal_two_sided(z).alias("p_value"),
    )


def histogram(df: DataFrame, value: str, low: float, high: float, width: float) -> DataFrame:
    """Fixed-width bin counts over [low, high]; the last bin is closed and empty bins appear with 0."""
    bins = round((high - low) / width)
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    index = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = inside.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = F.lit(low) + F.col("bin") * F.lit(width)
    return spine.join(counted, "bin", "left").select(
        "bin", edge.alias("bin_low"), (edge + width).alias("bin_high"),
        (edge + width / 2.0).alias("center"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def bunching_fit(bins: DataFrame, threshold: float, donut: float) -> DataFrame:
    """Bins with the count predicted by a cubic in log(centre) fitted outside the donut.

    log(centre) is divided by the threshold first, which keeps the powers well conditioned.
    """
    u = F.log(F.col("center") / threshold)
    powers = bins.select("*", u.alias("u1"), (u * u).alias("u2"), (u * u * u).alias("u3"), F.col("n").cast("double").alias("label"))
    design = VectorAssembler(inputCols=["u1", "u2", "u3"], outputCol="features").transform(powers)
    outside = design.where((F.col("center") < threshold - donut) | (F.col("center") > threshold + donut))
    model = LinearRegression(solver="normal", regParam=0.0).fit(outside)
    return model.transform(design).select(*bins.columns, F.col("prediction").alias("predicted"))


def bunching_test(fitted: DataFrame, threshold: float, width: float) -> DataFrame:
    """Observed and predicted counts just above / below the threshold, excess and Poisson Z."""
    above = (F.col("center") > threshold) & (F.col("center") <= threshold + width)
    below = (F.col("center") < threshold) & (F.col("center") >= threshold - width)

    def total(column: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))

    sums = fitted.agg(
        total("n", below).cast("bigint").alias("observed_below"), total("predicted", below).alias("predicted_below"),
        total("n", above).cast("bigint").alias("observed_above"), total("predicted", above).alias("predicted_above"),
    )
    return poisson_excess(sums)


def poisson_excess(sums: DataFrame) -> DataFrame:
    excess = F.col("observed_above") - F.col("predicted_above")
    z = excess / F.sqrt(F.greatest(F.col("predicted_above"), F.lit(1.0)))
    return sums.select("*", excess.alias("excess"), z.alias("z")).withColumn("regime", bunching_regime("z"))


def bunching_regime(z: str) -> Column:
    return (
        F.when(F.col(z) > SIGNIFICANT_Z, "policy bunching")
        .when(F.col(z) < -SIGNIFICANT_Z, "structural kink")
        .otherwise("clean")
    )


def cost_benefit(treated: DataFrame, effects: DataFrame, margin: float = INCREMENTAL_MARGIN) -> DataFrame:
    """Subsidy against incremental margin, one row.

    `treated`: one row with `n_orders, avg_freight, avg_payment` of the eligible-and-post
    cell. `effects`: one row with `base_logit`, `repeat_shift` (logit), `spend_shift` (log).
    """
    packed = effects.select(F.struct("base_logit", "repeat_shift", "spend_shift").alias("e")).scalar()
    inputs = treated.select("n_orders", "avg_freight", "avg_payment", packed.alias("e")).select(
        "n_orders", "avg_freight", "avg_payment",
        ex.logistic("e.base_logit").alias("p_control"),
        ex.logistic(F.col("e.base_logit") + F.col("e.repeat_shift")).alias("p_treated"),
        F.exp("e.spend_shift").alias("spend_multiplier"),
    )
    spend, m = F.col("avg_payment"), F.col("spend_multiplier")
    lift = F.col("p_treated") * spend * (m - 1.0) + (F.col("p_treated") - F.col("p_control")) * spend * m
    sized = inputs.select(
        "*", (F.col("n_orders") * F.col("avg_freight")).alias("subsidy"),
        (F.col("n_orders") * lift).alias("incremental_gmv"),
    )
    return sized.select(
        "*", (F.col("incremental_gmv") * margin).alias("incremental_margin"),
        (F.col("incremental_gmv") * margin - F.col("subsidy")).alias("net"),
        F.try_divide(F.col("subsidy"), F.col("incremental_gmv")).alias("break_even_margin"),
    )


def naive_vs_did(naive: DataFrame, did: DataFrame) -> DataFrame:
    """One row: the arm difference that mixes everything, beside its decomposition."""
    left = naive.select(
        F.lit(1).alias("__one"), (F.col("diff") * 100.0).alias("naive_pp"), F.col("z").alias("naive_z"),
        F.col("p_value").alias("naive_p"),
    )
    right = did.select(
        F.lit(1).alias("__one"), "beta_eligible", "beta_post", "did_logit", "did_se", "did_pp",
        F.col("p_value").alias("did_p"),
    )
    return left.join(right, "__one").drop("__one")
