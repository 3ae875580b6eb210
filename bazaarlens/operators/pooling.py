"""Partially pooled effects per category (empirical Bayes).

Rows are reduced to a few counts or moments per (category, eligible, post); everything after
that works on one small row per category. Intervals condition on the estimated spread
between categories, so they are somewhat narrow when there are few categories.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import distributions as dist
from bazaarlens.functions import expressions as ex

# ---- fixed values -----------------------------------------------------------------
HALDANE = 0.5             # added to every count, so that empty cells stay finite
INTERVAL_Z = 1.880794     # half-width of a 94% normal interval in standard deviations
CELL_SIGNS = {(1, 1): 1, (1, 0): -1, (0, 1): -1, (0, 0): 1}
ARM_SIGNS = {1: 1, 0: -1}
PRIOR_SCENARIOS = {"estimated": 1.0, "halved": 0.5, "fixed_0.04": None}
FIXED_TAU2 = 0.04
BASE_RATES = {"on_time": 0.89, "repeat": 0.023}  # rates at which logit effects are read as points
PP_PER_LOGIT = 0.11       # probability points per logit near the 89% base rate
# -----------------------------------------------------------------------------------


def _contrast(counts: DataFrame, keys: Sequence[str], cells: dict) -> DataFrame:
    """Signed sum of corrected log-odds over the cells, and its variance, per key."""
    effect, variance = F.lit(0.0), F.lit(0.0)
    aggregates = []
    for i, (condition, _) in enumerate(cells.values()):
        aggregates += [
            F.coalesce(F.sum(F.when(condition, F.col("successes"))), F.lit(0)).alias(f"s{i}"),
            F.coalesce(F.sum(F.when(condition, F.col("trials") - F.col("successes"))), F.lit(0)).alias(f"f{i}"),
        ]
    sums = counts.groupBy(*keys).agg(F.sum("trials").cast("bigint").alias("n"), *aggregates)
    for i, (_, sign) in enumerate(cells.values()):
        s, f = F.col(f"s{i}") + HALDANE, F.col(f"f{i}") + HALDANE
        effect = effect + F.lit(float(sign)) * F.log(s / f)
        variance = variance + F.lit(1.0) / s + F.lit(1.0) / f
    return sums.select(*keys, "n", effect.alias("effect"), variance.alias("variance"))


def category_did_logit(cells: DataFrame, category: str = "category", keys: Sequence[str] = ()) -> DataFrame:
    """Log-odds difference-in-differences per category.

    `cells` has `eligible, post, trials, successes` at any grain that contains the category.
    """
    signed = {
        c: ((F.col("eligible") == c[0]) & (F.col("post") == c[1]), sign) for c, sign in CELL_SIGNS.items()
    }
    return _contrast(cells, [*keys, category], signed)


def category_arm_logit(cells: DataFrame, category: str = "category", arm: str = "treatment") -> DataFrame:
    """Log-odds difference between the arms per category (the naive contrast)."""
    signed = {a: (F.col(arm) == a, sign) for a, sign in ARM_SIGNS.items()}
    return _contrast(cells, [category], signed)


def outcome_cells(
    df: DataFrame, category: str, success: Column, keys: Sequence[str] = ("eligible", "post"), weight: str | None = None
) -> DataFrame:
    """Rows (or finer cells of `weight` rows and `success` successes) → `category, keys…, trials, successes`."""
    trials, hits = ex.tally(success, weight)
    return df.groupBy(F.col(category).alias("category"), *keys).agg(ex.total(trials).alias("trials"), ex.total(hits).alias("successes"))


def partial_pool(
    effects: DataFrame,
    group: Sequence[str] = (),
    tau2: Column | None = None,
) -> DataFrame:
    """Shrink category effects to their precision-weighted mean (DerSimonian–Laird).

    `effects` holds one row per category (and group) with `effect, variance`; a category
    without an estimate (NULL) is set to the mean. `tau2` overrides the between-category
    variance; it may use the column `tau2_dl`.
    """
    whole = Window.partitionBy(*group)
    weight = F.try_divide(F.lit(1.0), F.col("variance"))
    moments = effects.withColumn("__w", weight).select(
        "*",
        F.sum("__w").over(whole).alias("__sw"),
        F.sum(F.col("__w") * F.col("__w")).over(whole).alias("__sw2"),
        F.sum(F.col("__w") * F.col("effect")).over(whole).alias("__swe"),
        F.sum(F.col("__w") * F.col("effect") * F.col("effect")).over(whole).alias("__swe2"),
        F.count("__w").over(whole).alias("__k"),
    )
    q = F.col("__swe2") - F.col("__swe") * F.col("__swe") / F.col("__sw")
    c = F.col("__sw") - F.col("__sw2") / F.col("__sw")
    raw = F.coalesce(F.try_divide(q - (F.col("__k") - 1), c), F.lit(0.0))
    # below 1e-12 the spread is rounding noise of Q − (k − 1)
    spread = moments.withColumn("tau2_dl", F.when(raw > 1e-12, raw).otherwise(0.0)).withColumn(
        "tau2", F.col("tau2_dl") if tau2 is None else tau2
    )
    pooled_weight = F.when(F.col("effect").isNotNull(), 1.0 / (F.col("variance") + F.col("tau2")))
    centred = spread.withColumn("__pw", pooled_weight).select(
        "*",
        (F.sum(F.col("__pw") * F.col("effect")).over(whole) / F.sum("__pw").over(whole)).alias("mu"),
        (1.0 / F.sum("__pw").over(whole)).alias("mu_variance"),
    )
    pull = F.coalesce(F.try_divide(F.col("variance"), F.col("variance") + F.col("tau2")), F.lit(1.0))
    own = F.coalesce(
        F.try_divide(F.col("variance") * F.col("tau2"), F.col("variance") + F.col("tau2")), F.col("tau2")
    )
    shrunk = (F.lit(1.0) - F.col("__pull")) * F.coalesce("effect", F.lit(0.0)) + F.col("__pull") * F.col("mu")
    deviation = F.sqrt(own + F.col("__pull") * F.col("__pull") * F.col("mu_variance"))
    final = centred.withColumn("__pull", pull).select(
        "*", shrunk.alias("shrunk"), deviation.alias("shrunk_sd")
    )
    half = F.lit(INTERVAL_Z) * F.col("shrunk_sd")
    names = [c for c in effects.columns if c not in ("effect", "variance")]
    return final.select(
        *names, "effect", "variance", "tau2", "mu", F.sqrt("mu_variance").alias("mu_sd"),
        "shrunk", "shrunk_sd",
        (F.col("shrunk") - half).alias("low"), (F.col("shrunk") + half).alias("high"),
        dist.normal_cdf(F.col("shrunk") / F.col("shrunk_sd")).alias("p_positive"),
    )


def pooled_mean(pooled: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The global effect: one row per group with mean, sd, interval, P(>0) and tau."""
    z = F.col("mu") / F.col("mu_sd")
    return (
        pooled.groupBy(*group)
        .agg(F.max("mu").alias("mu"), F.max("mu_sd").alias("mu_sd"), F.sqrt(F.max("tau2")).alias("tau"),
             F.count(F.lit(1)).alias("categories"))
        .select(
            *group, "categories", "mu", "mu_sd", "tau",
            (F.col("mu") - INTERVAL_Z * F.col("mu_sd")).alias("low"),
            (F.col("mu") + INTERVAL_Z * F.col("mu_sd")).alias("high"),
            dist.normal_cdf(z).alias("p_positive"),
        )
    )


def hurdle_stage_one(revenue: DataFrame) -> DataFrame:
    """Did the customer come back: log-odds DiD per first category."""
    cells = outcome_cells(revenue, "first_category", F.col("economic_repeat"))
    return category_did_logit(cells)


def spend_moments(revenue: DataFrame) -> DataFrame:
    """Moments of log spend and log first subtotal among returning customers, per cell."""
    y, x = F.log("repeat_revenue"), F.col("log_first_subtotal")
    n = F.count(F.lit(1))
    return revenue.where(F.col("economic_repeat") == 1).groupBy(
        F.col("first_category").alias("category"), "eligible", "post"
    ).agg(
        n.alias("n"), F.avg(y).alias("y"), F.avg(x).alias("x"),
        (F.var_pop(x) * n).alias("sxx"), (F.var_pop(y) * n).alias("syy"),
        (F.covar_pop(x, y) * n).alias("sxy"),
    )


def hurdle_stage_two(revenue: DataFrame) -> DataFrame:
    """How much returning customers spend: DiD of mean log spend per category.

    Cell means are adjusted by the slope on log first subtotal, pooled within cells. A
    category with an empty cell has no estimate (NULL) and is pooled to the mean.
    """
    cells = spend_moments(revenue)
    whole = Window.partitionBy()
    fitted = cells.select(
        "*",
        F.sum("sxx").over(whole).alias("sxx_all"), F.sum("sxy").over(whole).alias("sxy_all"),
        F.sum("syy").over(whole).alias("syy_all"),
        (F.sum("n").over(whole) - F.count(F.lit(1)).over(whole) - 1).alias("freedom"),
    ).withColumn("slope", F.coalesce(F.try_divide(F.col("sxy_all"), F.col("sxx_all")), F.lit(0.0)))
    sign = reduce(
        lambda acc, item: acc.when((F.col("eligible") == item[0][0]) & (F.col("post") == item[0][1]), float(item[1])),
        CELL_SIGNS.items(), F,
    )
    per_category = fitted.withColumn("sign", sign).groupBy("category").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"),
        F.sum(F.col("sign") * (F.col("y") - F.col("slope") * F.col("x"))).alias("did"),
        F.sum(F.col("sign") * F.col("x")).alias("did_x"),
        F.sum(1.0 / F.col("n")).alias("inverse_n"),
        F.max("sxx_all").alias("sxx_all"),
        F.max(
            F.try_divide(
                F.greatest(F.col("syy_all") - F.col("slope") * F.col("sxy_all"), F.lit(0.0)),
                F.col("freedom").cast("double"),
            )
        ).alias("s2"),
    )
    complete = F.col("cells") == len(CELL_SIGNS)
    leverage = F.coalesce(F.try_divide(F.col("did_x") * F.col("did_x"), F.col("sxx_all")), F.lit(0.0))
    return per_category.select(
        "category", "n",
        F.when(complete, F.col("did")).alias("effect"),
        F.when(complete, F.col("s2") * (F.col("inverse_n") + leverage)).alias("variance"),
    )


def hurdle_effects(revenue: DataFrame) -> DataFrame:
    """Both stages, pooled, stacked by `stage`."""
    stages = hurdle_stage_one(revenue).withColumn("stage", F.lit("repeat")).unionByName(
        hurdle_stage_two(revenue).withColumn("stage", F.lit("spend"))
    )
    return partial_pool(stages, ["stage"])


def threshold_cells(reviews: DataFrame, levels: int = 5, category: str = "category_en") -> DataFrame:
    """Counts at or above each threshold: `category, eligible, post, threshold, trials, successes`."""
    counts = reviews.groupBy(F.col(category).alias("category"), "eligible", "post").agg(
        F.count("score_index").alias("trials"),
        *[F.count_if(F.col("score_index") >= k).alias(f"above{k}") for k in range(1, levels)],
    )
    steps = F.array(
        *[F.struct(F.lit(k).alias("threshold"), F.col(f"above{k}").alias("successes")) for k in range(1, levels)]
    )
    return counts.select("category", "eligible", "post", "trials", F.explode(steps).alias("s")).select(
        "category", "eligible", "post", "s.threshold", "trials", "s.successes"
    )


def ordinal_category_effects(reviews: DataFrame, levels: int = 5) -> DataFrame:
    """Cumulative-logit DiD per category: inverse-variance mean over the thresholds.

    Threshold estimates of one category are correlated, so the combined variance is an
    approximation (too small); read it as a scale for pooling.
    """
    steps = category_did_logit(threshold_cells(reviews, levels), keys=["threshold"])
    weight = 1.0 / F.col("variance")
    return steps.groupBy("category").agg(
        F.max("n").alias("n"),
        (F.sum(weight * F.col("effect")) / F.sum(weight)).alias("effect"),
        (1.0 / F.sum(weight)).alias("variance"),
    )


def ordinal_effects(reviews: DataFrame, levels: int = 5) -> DataFrame:
    return partial_pool(ordinal_category_effects(reviews, levels))


def ordinal_cutpoints(reviews: DataFrame, levels: int = 5) -> DataFrame:
    """Cutpoints of the pooled score distribution, anchored at 0, and the gaps between them."""
    totals = threshold_cells(reviews, levels).groupBy("threshold").agg(
        F.sum("trials").alias("trials"), F.sum("successes").alias("above")
    )
    below = F.log((F.col("trials") - F.col("above") + HALDANE) / (F.col("above") + HALDANE))
    ladder = Window.partitionBy().orderBy("threshold")
    return totals.withColumn("__k", below).select(
        "threshold",
        (F.col("__k") - F.first("__k").over(ladder)).alias("cutpoint"),
        (F.col("__k") - F.lag("__k").over(ladder)).alias("gap"),
    )


def treated_level(cells: DataFrame) -> DataFrame:
    """`category, level`: corrected log-odds of the eligible, post-policy cell."""
    here = (F.col("eligible") == 1) & (F.col("post") == 1)
    s, f = (F.coalesce(F.sum(F.when(here, v)), F.lit(0)) + HALDANE for v in (F.col("successes"), F.col("trials") - F.col("successes")))
    return cells.groupBy("category").agg(F.log(s / f).alias("level"))


def predictive_limits(pooled: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Each category's estimate against what the fitted pool predicts for it, in closed form.

    A new category's estimate is normal around the pooled mean with the variance of the
    estimate, between categories, and of the mean. With `levels` (see `treated_level`) the
    comparison is made for the treated cell's rate: the other cells and the pooled effect
    predict it. GOOD inside the 94% limits, CHECK outside; categories without an estimate
    are left out.
    """
    known = pooled.where(F.col("effect").isNotNull())
    sd = F.sqrt(F.col("variance") + F.col("tau2") + F.col("mu_sd") * F.col("mu_sd"))
    seen, scale = F.col("effect"), (lambda v: v)
    if levels is not None:
        known = known.join(levels, "category")
        seen, scale = F.col("level"), ex.logistic
    middle = seen - F.col("effect") + F.col("mu")
    limits = known.withColumns({"__m": middle, "__h": F.lit(INTERVAL_Z) * sd, "z": (F.col("effect") - F.col("mu")) / sd})
    keys = [c for c in ("stage", "category") if c in pooled.columns]
    inside = F.abs("z") <= INTERVAL_Z
    return limits.select(
        *keys, scale(seen).alias("observed"), scale(F.col("__m")).alias("predicted"),
        scale(F.col("__m") - F.col("__h")).alias("low"), scale(F.col("__m") + F.col("__h")).alias("high"), "z",
        F.when(inside, "GOOD").otherwise("CHECK").alias("verdict"),
    )


def prior_sensitivity(effects: DataFrame) -> DataFrame:
    """The pooled mean under several rules for the between-category variance.

    Rules: estimated, half of it, and a fixed value. One row per rule, with the spread of
    the mean over the rules in logits and in probability points.
    """
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("prior"), F.lit(factor).cast("double").alias("factor"))
            for name, factor in PRIOR_SCENARIOS.items()
        ]
    )
    scenarios = effects.withColumn("__rule", F.explode(rules)).select("*", "__rule.prior", "__rule.factor").drop("__rule")
    tau2 = F.coalesce(F.col("factor") * F.col("tau2_dl"), F.lit(FIXED_TAU2))
    means = pooled_mean(partial_pool(scenarios, ["prior"], tau2), ["prior"])
    whole = Window.partitionBy()
    spread = F.max("mu").over(whole) - F.min("mu").over(whole)
    return means.select("*", spread.alias("spread"), (spread * 100.0 * PP_PER_LOGIT).alias("spread_pp"))


def top_effects(pooled: DataFrame, n: int = 5, ascending: bool = False, group: Sequence[str] = ()) -> DataFrame:
    """The n largest (or smallest) shrunk effects per group, with their rank; ties by name."""
    order = F.asc("shrunk") if ascending else F.desc("shrunk")
    place = Window.partitionBy(*group).orderBy(order, "category")
    return pooled.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def side_by_side(outcomes: dict[str, DataFrame]) -> DataFrame:
    """Effects of several outcomes by category; no total over the unlike scales is formed."""
    frames = [
        df.select(
            "category", F.col("shrunk").alias(f"{name}_effect"), F.col("low").alias(f"{name}_low"),
            F.col("high").alias(f"{name}_high"), F.col("p_positive").alias(f"{name}_p_positive"),
        )
        for name, df in outcomes.items()
    ]
    return reduce(lambda a, b: a.join(b, "category", "full"), frames)


def rollout_shortlist(favourable: dict[str, DataFrame], harmed: DataFrame, n: int = 5, at_least: int = 2) -> DataFrame:
    """Categories in several favourable top-n lists and absent from the n most harmed."""
    lists = [
        top_effects(df, n).select("category", F.lit(name).alias("outcome")) for name, df in favourable.items()
    ]
    memberships = reduce(DataFrame.unionByName, lists).groupBy("category").agg(
        F.count(F.lit(1)).alias("lists"), F.array_join(F.sort_array(F.collect_set("outcome")), ",").alias("outcomes")
    )
    worst = top_effects(harmed, n, ascending=True).select("category")
    return memberships.where(F.col("lists") >= at_least).join(worst, "category", "left_anti")


def recommendations(outcomes: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """The n best and n worst categories of every outcome, with the `size` of the effect in its own terms.

    Logit effects with a base rate become percentage points there, spend a multiplier; other
    scales have no size.
    """
    parts = []
    for name, pooled in outcomes.items():
        size = F.lit(None).cast("double")
        if name in BASE_RATES:
            size = ex.logit_to_points("shrunk", BASE_RATES[name])
        elif name == "spend":
            size = F.exp("shrunk")
        for direction, ascending in (("best", False), ("worst", True)):
            parts.append(top_effects(pooled, n, ascending).select(
                F.lit(name).alias("outcome"), F.lit(direction).alias("direction"), "rank", "category",
                "shrunk", "low", "high", "p_positive", size.alias("size"),
            ))
    return reduce(DataFrame.unionByName, parts)


def effect_points(pooled: DataFrame, base: float) -> DataFrame:
    """Shrunk logit effects as probability points at a base rate."""
    return pooled.withColumn("points", ex.logit_to_points("shrunk", base))
