"""Draws tables `(param, category, chain, draw, value)` and the summaries taken from them.

Draws come from a Poisson bootstrap. The sum of independent Poisson(1) row weights over a
cell of n rows is Poisson(n), so weights are drawn per cell of the panel instead of per row: the
same distribution, by exact inversion for every n. Time and memory of a cell grow with
its draws and √n. Every draw is a function of (seed, cell, draw) by md5, so a lost task
repeats it exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from bazaarlens.functions.distributions import log_gamma
from bazaarlens.operators.ordered import ROWS_PER_SLICE, group_sequence
from bazaarlens.operators.pooling import category_did_logit
from bazaarlens.session import ship_by_value

ship_by_value(__name__)

# ---- fixed values -----------------------------------------------------------------
INTERVAL = (0.03, 0.97)       # equal-tailed 94% interval
PREDICTIVE_INTERVAL = (0.05, 0.95)
PREDICTIVE_TOLERANCE = 0.005  # largest gap between observed and replicated rate
TWO_52 = 4503599627370496.0
# -----------------------------------------------------------------------------------


def _uniform(digest: Column) -> Column:
    """A number in (0, 1) from thirteen hexadecimal digits."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / TWO_52


def _uniforms(label: Column, turns: Column) -> Column:
    return F.transform(turns, lambda t: _uniform(F.md5(F.concat_ws("|", label, t.cast("string")))))


def poisson_quantiles(mean: float, u: np.ndarray) -> np.ndarray:
    """Smallest k with P(N ≤ k) ≥ u, from the terms next to the mode; those left out sum to less than 1e-30."""
    if not mean > 0:
        return np.zeros(len(u), dtype=np.int64)
    reach, mode = 12.0 * math.sqrt(mean) + 40.0, int(mean)
    low, high = max(0, int(mode - reach)), int(mode + reach)
    down = np.cumsum(np.log(np.arange(mode, low, -1) / mean))[::-1]
    up = -np.cumsum(np.log(np.arange(mode + 1, high + 1) / mean))
    cdf = np.cumsum(np.exp(np.concatenate((down, [0.0], up))))
    return low + np.minimum(np.searchsorted(cdf / cdf[-1], u), high - low)


@F.pandas_udf(ArrayType(LongType()))
def _poisson(mean: pd.Series, uniforms: pd.Series) -> pd.Series:
    return pd.Series([poisson_quantiles(m, u) for m, u in zip(mean.fillna(0.0), uniforms, strict=True)])


def bootstrap_counts(
    cells: DataFrame, keys: Sequence[str], counts: Sequence[str], draws: int, seed: int = 0, chains: int = 4
) -> DataFrame:
    """Each cell and each draw: every count replaced by a Poisson draw around it."""
    turns = F.sequence(F.lit(0), F.lit(draws - 1))
    columns = []
    for name in counts:
        label = F.concat_ws("|", F.lit(str(seed)), F.lit(name), *[F.col(k).cast("string") for k in keys])
        columns.append(_poisson(F.col(name).cast("double"), _uniforms(label, turns)).alias(f"__{name}"))
    drawn = cells.select(*keys, *columns).select("*", F.explode(turns).alias("__t"))
    per_chain = math.ceil(draws / chains)
    return drawn.select(
        *keys, *[F.get(f"__{name}", F.col("__t")).alias(name) for name in counts],
        F.floor(F.col("__t") / per_chain).cast("int").alias("chain"),
        (F.col("__t") % per_chain).cast("int").alias("draw"),
    )


def bootstrap_cells(cells: DataFrame, draws: int, seed: int = 0, chains: int = 4) -> DataFrame:
    """Bootstrap of `category, eligible, post, trials, successes` cells."""
    split = cells.withColumn("failures", F.col("trials") - F.col("successes"))
    keys = ["category", "eligible", "post"]
    drawn = bootstrap_counts(split, keys, ["successes", "failures"], draws, seed, chains)
    return drawn.select(
        *keys, "chain", "draw", (F.col("successes") + F.col("failures")).alias("trials"), "successes"
    )


def bootstrap_effects(cells: DataFrame, draws: int, seed: int = 0, chains: int = 4) -> DataFrame:
    """Draws of the per-category log-odds difference-in-differences.

    Twelve decimals are kept, so that cells with equal odds give exactly 0.
    """
    drawn = bootstrap_cells(cells, draws, seed, chains)
    effects = category_did_logit(drawn, keys=["chain", "draw"])
    return effects.select(
        F.lit("did_logit").alias("param"), "category", "chain", "draw", F.round("effect", 12).alias("value")
    )


def summarise_draws(draws: DataFrame) -> DataFrame:
    """Mean, sd, 3/97 percentiles and P(>0). A group holds chains × draws values by construction."""
    low, high = INTERVAL
    return draws.groupBy("param", "category").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.percentile("value", F.lit(low)).alias("p3"), F.percentile("value", F.lit(high)).alias("p97"),
        F.avg((F.col("value") > 0).cast("double")).alias("p_positive"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def hdi(draws: DataFrame, prob: float = 0.94, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Shortest interval that holds ⌊prob · n⌋ steps of the sorted draws."""
    keys = ["param", "category"]
    ranked = group_sequence(
        draws, keys, ["value", "chain", "draw"], rank="rank", total="n", rows_per_slice=rows_per_slice
    ).select(*keys, "rank", "n", "value")
    upper = ranked.select(*keys, F.col("rank").alias("__to"), F.col("value").alias("high"))
    step = F.floor(F.col("n") * prob).cast("bigint")
    spans = ranked.withColumn("__to", F.col("rank") + step).join(upper, [*keys, "__to"])
    shortest = F.min(F.struct((F.col("high") - F.col("value")).alias("width"), F.col("value").alias("low"), "high"))
    return spans.groupBy(*keys).agg(shortest.alias("s")).select(*keys, F.col("s.low").alias("hdi_low"), F.col("s.high").alias("hdi_high"))


def rhat(draws: DataFrame) -> DataFrame:
    """√(pooled variance / mean within-chain variance)."""
    chains = draws.groupBy("param", "category", "chain").agg(
        F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    across = chains.groupBy("param", "category").agg(
        F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n"),
        F.count(F.lit(1)).alias("chains"),
    )
    pooled = F.col("within") * (F.col("n") - 1.0) / F.col("n") + F.col("between")
    return across.select("param", "category", "chains", F.sqrt(F.try_divide(pooled, F.col("within"))).alias("rhat"))


@F.pandas_udf(ArrayType(DoubleType()))
def _autocovariances(chains: pd.Series) -> pd.Series:
    """Autocovariances of centred chains at lags 0 … n − 2."""

    def of_chain(x: np.ndarray) -> np.ndarray:
        n = len(x)
        spectrum = np.fft.rfft(x, 2 * n)
        return np.fft.irfft(spectrum * np.conj(spectrum), 2 * n)[: max(n - 1, 1)] / n

    return chains.map(of_chain)


def ess(draws: DataFrame) -> DataFrame:
    """Effective sample size from chain autocorrelations, summed in pairs while positive.

    A chain is sorted as one array: its length is the number of draws, a parameter.
    """
    series = F.transform(F.array_sort(F.collect_list(F.struct("draw", "value"))), lambda s: s["value"])
    chains = draws.groupBy("param", "category", "chain").agg(
        series.alias("x"), F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    centred = chains.withColumn("x", F.transform("x", lambda v: v - F.col("m")))
    lagged = centred.select(
        "param", "category", "chain", "m", "v", "n", F.posexplode(_autocovariances("x")).alias("lag", "acov")
    )
    per_lag = lagged.groupBy("param", "category", "lag").agg(
        F.avg("acov").alias("acov"), F.avg("v").alias("within"), F.var_samp("m").alias("between"),
        F.avg("n").alias("n"), F.sum("n").alias("total"),
    )
    pooled = F.col("within") * (F.col("n") - 1.0) / F.col("n") + F.coalesce("between", F.lit(0.0))
    rho = F.lit(1.0) - (F.col("within") - F.col("acov")) / pooled
    ordered = per_lag.withColumn("rho", F.when(F.col("lag") == 0, 1.0).otherwise(rho)).groupBy("param", "category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "rho"))), lambda s: s["rho"]).alias("r"),
        F.max("total").alias("total"),
    )

    def add(state: Column, pair: Column) -> Column:
        alive = state["alive"] & (pair > 0)
        return F.struct(alive.alias("alive"), (state["sum"] + F.when(alive, pair).otherwise(0.0)).alias("sum"))

    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("r") / 2).cast("int") - 1),
        lambda k: F.get(F.col("r"), k * 2) + F.get(F.col("r"), k * 2 + 1),
    )
    summed = F.aggregate(
        pairs, F.struct(F.lit(True).alias("alive"), F.lit(0.0).alias("sum")), add, lambda s: s["sum"]
    )
    tau = F.greatest(summed * 2.0 - 1.0, F.lit(1.0) / F.log10(F.col("total")))
    return ordered.select("param", "category", (F.col("total") / tau).alias("ess"))


def binomial_loglik(cells: DataFrame, drawn: DataFrame, model: str) -> DataFrame:
    """`model, cell, chain, draw, loglik` of observed cells under the rates of each draw."""
    keys = ["category", "eligible", "post"]
    rate = (F.col("successes") + 0.5) / (F.col("trials") + 1.0)
    rates = drawn.select(*keys, "chain", "draw", rate.alias("p"))
    n, k = F.col("trials").cast("double"), F.col("successes").cast("double")
    ways = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)
    observed = cells.select(*keys, "trials", "successes", ways.alias("ways"))
    loglik = F.col("ways") + k * F.log("p") + (n - k) * F.log1p(-F.col("p"))
    return observed.join(rates, keys).select(
        F.lit(model).alias("model"), F.concat_ws("|", *keys).alias("cell"), "chain", "draw", loglik.alias("loglik")
    )


def _elpd_totals(pointwise: DataFrame, names: Mapping[str, str]) -> DataFrame:
    elpd, p = names["elpd"], names["p"]
    return pointwise.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("lppd").alias("lppd"), F.sum(p).alias(p), F.sum(elpd).alias(elpd),
        F.sqrt(F.count(F.lit(1)) * F.var_pop(elpd)).alias("se"), F.avg(elpd).alias("elpd_per_cell"),
    )


def _log_mean_exp(x: str, top: str) -> Column:
    return F.log(F.avg(F.exp(F.col(x) - F.col(top)))) + F.max(top)


def waic(loglik: DataFrame) -> DataFrame:
    """lppd, effective parameters and elpd per model (widely applicable information criterion)."""
    cell = Window.partitionBy("model", "cell")
    pointwise = loglik.withColumn("__top", F.max("loglik").over(cell)).groupBy("model", "cell").agg(
        _log_mean_exp("loglik", "__top").alias("lppd"), F.var_pop("loglik").alias("p_waic")
    ).withColumn("elpd_waic", F.col("lppd") - F.col("p_waic"))
    return _elpd_totals(pointwise, {"elpd": "elpd_waic", "p": "p_waic"})


def loo_truncated(loglik: DataFrame) -> DataFrame:
    """Leave-one-out elpd by importance weights 1/likelihood, truncated at √draws times their mean."""
    cell = Window.partitionBy("model", "cell")
    raw = loglik.select(
        "*", F.max("loglik").over(cell).alias("__top"), F.min("loglik").over(cell).alias("__low"),
        F.count(F.lit(1)).over(cell).alias("__s"),
    ).withColumn("__w", F.exp(F.col("__low") - F.col("loglik")))
    weighted = raw.withColumn("__cap", F.avg("__w").over(cell) * F.sqrt("__s")).withColumn(
        "__w", F.least("__w", "__cap")
    )
    predictive = F.log(F.sum(F.col("__w") * F.exp(F.col("loglik") - F.col("__top"))) / F.sum("__w")) + F.max("__top")
    pointwise = weighted.groupBy("model", "cell").agg(
        _log_mean_exp("loglik", "__top").alias("lppd"), predictive.alias("elpd_loo")
    ).withColumn("p_loo", F.col("lppd") - F.col("elpd_loo"))
    return _elpd_totals(pointwise, {"elpd": "elpd_loo", "p": "p_loo"})


def _pareto_fit(tail: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto tail (profile-posterior mean of Zhang and Stephens)."""
    x = np.sort(tail)
    n = len(x)
    m = 30 + int(np.sqrt(n))
    quarter = x[int(n / 4 + 0.5) - 1]
    theta = 1.0 / x[-1] + (1.0 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3.0 * quarter)
    shape = np.array([np.mean(np.log1p(-t * x)) for t in theta])
    profile = n * (np.log(-theta / shape) - shape - 1.0)
    weights = np.array([1.0 / np.sum(np.exp(profile - p)) for p in profile])
    best = float(np.sum(weights * theta))
    k = float(np.mean(np.log1p(-best * x)))
    return (k * n + 0.5 * 10.0) / (n + 10.0), -k / best


def _smooth_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pareto-smoothed leave-one-out terms of one cell: a group is the draws of one cell."""
    loglik = pdf["loglik"].to_numpy()
    s = len(loglik)
    log_w = -loglik - np.max(-loglik)
    size = int(min(0.2 * s, 3.0 * np.sqrt(s)))
    k = float("nan")
    if size >= 5:
        order = np.argsort(log_w)
        tail = order[-size:]
        cut = np.exp(log_w[order[-size - 1]])
        excess = np.exp(log_w[tail]) - cut
        if excess.max() > 1e-12:
            k, scale = _pareto_fit(np.maximum(excess, 1e-15))
            quantile = (np.arange(1, size + 1) - 0.5) / size
            lifted = scale * np.expm1(-k * np.log1p(-quantile)) / k if abs(k) > 1e-12 else -scale * np.log1p(-quantile)
            log_w[tail] = np.minimum(np.log(lifted + cut), 0.0)
    top = np.max(loglik)
    lppd = np.log(np.mean(np.exp(loglik - top))) + top
    joint = log_w + loglik
    peak = np.max(joint)
    elpd = np.log(np.sum(np.exp(joint - peak))) + peak - np.log(np.sum(np.exp(log_w)))
    return pd.DataFrame(
        {"model": pdf["model"].iloc[:1], "cell": pdf["cell"].iloc[:1], "lppd": lppd, "elpd_loo": elpd, "pareto_k": k}
    )


def loo_smoothed(loglik: DataFrame) -> DataFrame:
    """Leave-one-out elpd with Pareto-smoothed weights, and the worst tail shape per model."""
    pointwise = loglik.select("model", "cell", "loglik").groupBy("model", "cell").applyInPandas(
        _smooth_cell, "model string, cell string, lppd double, elpd_loo double, pareto_k double"
    ).withColumn("p_loo", F.col("lppd") - F.col("elpd_loo"))
    totals = _elpd_totals(pointwise, {"elpd": "elpd_loo", "p": "p_loo"})
    worst = pointwise.groupBy("model").agg(F.max(F.nanvl("pareto_k", F.lit(None))).alias("worst_pareto_k"))
    return totals.join(worst, "model")


def cell_elpd(cells: DataFrame, models: Mapping[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """`model, keys…, elpd`: exact leave-one-out log density of each cell under fitted rates.

    A model is a list of columns: all cells that agree on them share a rate, fitted on the
    group's other cells as (successes + 1/2) / (trials + 1). The groups are summed once and
    joined back, so the cost is one pass per model.
    """
    n, k = F.col("trials").cast("double"), F.col("successes").cast("double")
    ways = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)
    scored = []
    for model, group in models.items():
        sums = cells.groupBy(*group).agg(F.sum("trials").alias("__n"), F.sum("successes").alias("__k"))
        rate = (F.col("__k") - k + 0.5) / (F.col("__n") - n + 1.0)
        own = cells.join(sums, list(group)).withColumn("__p", rate)
        density = ways + k * F.log("__p") + (n - k) * F.log1p(-F.col("__p"))
        scored.append(own.select(F.lit(model).alias("model"), *keys, density.alias("elpd")))
    return reduce(DataFrame.unionByName, scored)


def compare_models(pointwise: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranked models: elpd with its standard error, and the paired difference to the best with its own.

    The difference is taken cell by cell, so what all models find hard cancels out. Refuses
    models scored on different cells.
    """
    totals = pointwise.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("elpd").alias("elpd"),
        F.sqrt(F.count(F.lit(1)) * F.var_pop("elpd")).alias("se"),
    )
    ranked = rank_models(totals, "elpd")
    best = ranked.where("rank = 1").select(F.col("model").alias("__best"))
    top = pointwise.join(F.broadcast(best), F.col("model") == F.col("__best")).select(*keys, F.col("elpd").alias("__top"))
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys])
    gap = (F.col("p.elpd") - F.col("t.__top")).alias("d")
    gaps = pointwise.alias("p").join(top.alias("t"), same).select("p.model", gap)
    paired = gaps.groupBy("model").agg(F.sum("d").alias("difference"), F.sqrt(F.count(F.lit(1)) * F.var_pop("d")).alias("difference_se"))
    return ranked.join(paired, "model")


def rank_models(elpd: DataFrame, column: str) -> DataFrame:
    """Models from best to worst; refuses models scored on different numbers of cells."""
    sizes = elpd.select("n_cells").distinct().limit(2).count()
    if sizes > 1:
        raise ValueError("models are scored on different cells; their elpd cannot be compared")
    return elpd.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(column), "model")))


def predictive_rate(observed: DataFrame, replicated: DataFrame) -> DataFrame:
    """Observed success rate against replicated ones: mean, 5/95 percentiles, GOOD or CHECK."""
    seen = observed.agg((F.sum("successes").cast("double") / F.sum("trials")).alias("rate")).scalar()
    per_draw = replicated.groupBy("chain", "draw").agg(
        F.try_divide(F.sum("successes").cast("double"), F.sum("trials").cast("double")).alias("rate")
    )
    low, high = PREDICTIVE_INTERVAL
    summary = per_draw.agg(
        F.avg("rate").alias("replicated"),
        F.percentile("rate", F.lit(low)).alias("p5"), F.percentile("rate", F.lit(high)).alias("p95"),
    ).withColumn("observed", seen)
    close = F.abs(F.col("replicated") - F.col("observed")) < PREDICTIVE_TOLERANCE
    return summary.select("observed", "replicated", "p5", "p95", F.when(close, "GOOD").otherwise("CHECK").alias("verdict"))


def predictive_mean(cells: DataFrame, replicated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed mean of `y` over cells of `n` rows, against replicated cell sizes."""
    seen = cells.agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("m")).scalar()
    per_draw = replicated.select(*keys, "chain", "draw", F.col("n").alias("__n")).join(
        cells.select(*keys, "y"), list(keys)
    ).groupBy("chain", "draw").agg(F.try_divide(F.sum(F.col("__n") * F.col("y")), F.sum("__n")).alias("m"))
    return per_draw.agg(F.avg("m").alias("replicated")).withColumn("observed", seen).select("observed", "replicated")


def predictive_shares(observed: DataFrame, replicated: DataFrame, level: str) -> DataFrame:
    """Observed share of every level against the mean replicated share."""
    whole = Window.partitionBy()
    seen = observed.select(level, (F.col("n") / F.sum("n").over(whole)).alias("observed"))
    per_draw = Window.partitionBy("chain", "draw")
    again = replicated.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(per_draw).cast("double")))
    return seen.join(again.groupBy(level).agg(F.avg("share").alias("replicated")), level)
