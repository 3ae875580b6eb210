"""Classical A/B tests. Rows are reduced by grouped aggregates; one row per test comes out."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bazaarlens.functions import distributions as dist
from bazaarlens.functions import expressions as ex
from bazaarlens.operators.ordered import (
    ROWS_PER_SLICE,
    median_of_counts,
    ranked_values,
    value_counts,
)
from bazaarlens.session import ship_by_value

ship_by_value(__name__)

EXACT_SMALL_ARM = 8  # the exact rank test is used up to this arm size, without ties


def _in_arm(arm: str, value: int) -> Column:
    return F.col(arm) == value


def arm_counts(df: DataFrame, success: str, arm: str = "treatment", weight: str | None = None) -> DataFrame:
    """One row: trials and successes of both arms; of cells with `weight` rows and `success` successes each, if given."""
    trials, hits = ex.tally(success, weight)
    return df.agg(
        ex.total(trials, _in_arm(arm, 1)).alias("n_treated"), ex.total(hits, _in_arm(arm, 1)).alias("successes_treated"),
        ex.total(trials, _in_arm(arm, 0)).alias("n_control"), ex.total(hits, _in_arm(arm, 0)).alias("successes_control"),
    )


def two_proportion_z(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pooled-SE z test with an unpooled Wald interval, from `arm_counts`."""
    n1, k1 = F.col("n_treated").cast("double"), F.col("successes_treated").cast("double")
    n0, k0 = F.col("n_control").cast("double"), F.col("successes_control").cast("double")
    pooled = F.try_divide(k1 + k0, n1 + n0)
    p1, p0 = F.col("rate_treated"), F.col("rate_control")
    pooled_se = F.sqrt(F.col("pooled") * (1.0 - F.col("pooled")) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    wald_se = F.sqrt(F.try_divide(p1 * (1.0 - p1), n1) + F.try_divide(p0 * (1.0 - p0), n0))
    half = F.lit(dist.normal_quantile(1.0 - alpha / 2.0)) * F.col("wald_se")
    rates = counts.select(
        "*", F.try_divide(k1, n1).alias("rate_treated"), F.try_divide(k0, n0).alias("rate_control"),
        pooled.alias("pooled"),
    )
    scored = rates.select(
        "*", (p1 - p0).alias("diff"), F.try_divide(p1 - p0, pooled_se).alias("z"), wald_se.alias("wald_se")
    )
    return scored.select(
        *counts.columns, "rate_treated", "rate_control", "diff", "z",
        dist.normal_two_sided("z").alias("p_value"),
        (F.col("diff") - half).alias("ci_low"), (F.col("diff") + half).alias("ci_high"),
    )


def welch_t(df: DataFrame, value: str, arm: str = "treatment", alpha: float = 0.05) -> DataFrame:
    """Unequal-variance t test with Satterthwaite degrees of freedom."""

    def in_arm(v: int) -> Column:
        return F.when(_in_arm(arm, v), F.col(value))

    moments = df.agg(
        F.avg(in_arm(1)).alias("mean_treated"), F.avg(in_arm(0)).alias("mean_control"),
        F.var_samp(in_arm(1)).alias("__v1"), F.var_samp(in_arm(0)).alias("__v0"),
        F.count(in_arm(1)).alias("n_treated"), F.count(in_arm(0)).alias("n_control"),
    )
    shares = moments.select(
        "*",
        F.try_divide(F.col("__v1"), F.col("n_treated")).alias("__a"),
        F.try_divide(F.col("__v0"), F.col("n_control")).alias("__b"),
        (F.col("mean_treated") - F.col("mean_control")).alias("diff"),
    )
    a, b, total = F.col("__a"), F.col("__b"), F.col("__a") + F.col("__b")
    df_welch = F.try_divide(
        total * total,
        F.try_divide(a * a, F.col("n_treated") - 1) + F.try_divide(b * b, F.col("n_control") - 1),
    )
    tested = shares.select(
        "*", F.sqrt(total).alias("__se"), F.try_divide(F.col("diff"), F.sqrt(total)).alias("t"),
        df_welch.alias("df"),
    )
    half = dist.student_critical("df", alpha) * F.col("__se")
    return tested.select(
        "n_treated", "n_control", "mean_treated", "mean_control", "diff", "t", "df",
        dist.student_two_sided("t", "df").alias("p_value"),
        (F.col("diff") - half).alias("ci_low"), (F.col("diff") + half).alias("ci_high"),
    )


def lower_rank_count(small: int, large: int, u: int) -> int:
    """How many of the C(small + large, small) untied arrangements have a rank statistic of at most u.

    The counts have the generating function Π (1 - q^(large + i)) / (1 - q^i), i = 1..small. With the period
    L = lcm(1..small) every denominator becomes (1 - q^L), so a coefficient is a short sum of binomials: the cost depends
    on the small arm only.
    """
    period, factors = math.lcm(*range(1, small + 1)), [1, *range(1, small + 1)]  # the extra 1 sums the counts up to u
    top = [1] + [0] * (period * len(factors))
    for i in factors:
        for k in range(i, len(top)):
            top[k] += top[k - i]
        for k in range(len(top) - 1, period - 1, -1):
            top[k] -= top[k - period]

    def up_to(m: int) -> int:
        return sum(top[r] * math.comb((m - r) // period + small, small) for r in range(m % period, min(m, len(top) - 1) + 1, period))

    signs = {0: 1}
    for i in range(1, small + 1):
        for shift, sign in list(signs.items()):
            signs[shift + large + i] = signs.get(shift + large + i, 0) - sign
    return sum(sign * up_to(u - shift) for shift, sign in signs.items() if shift <= u)


@F.pandas_udf(DoubleType())
def _exact_rank_p(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
    """Exact two-sided p of U for one tiny arm, whatever the size of the other."""

    def one(u_value: float, a: int, b: int) -> float:
        if not a or not b:
            return float("nan")
        small, large = min(a, b), max(a, b)
        lower = math.floor(min(u_value, a * b - u_value))
        return min(1.0, 2 * lower_rank_count(small, large, lower) / math.comb(a + b, small))

    return pd.Series([one(*row) for row in zip(u, n1.fillna(0).astype(int), n0.fillna(0).astype(int))])


def mann_whitney(
    df: DataFrame, value: str, arm: str = "treatment", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """U of the treated arm with medians; tie- and continuity-corrected normal p, exact for tiny arms.

    Rows collapse to distinct values before ranking, so a value that holds most rows (the
    zeros of a repeat-revenue column) costs one row.
    """
    ranked = ranked_values(value_counts(df, value, arm), rows_per_slice)
    tied = (F.col("n1") + F.col("n0")).cast("double")
    sums = ranked.agg(
        F.coalesce(F.max("total1"), F.lit(0)).alias("n_treated"),
        F.coalesce(F.max("total0"), F.lit(0)).alias("n_control"),
        median_of_counts("value", "n1", "below1", "total1").alias("median_treated"),
        median_of_counts("value", "n0", "below0", "total0").alias("median_control"),
        F.sum(F.col("midrank") * F.col("n1")).alias("__r1"),
        F.sum(tied * tied * tied - tied).alias("__ties"),
    )
    n1, n0 = F.col("n_treated").cast("double"), F.col("n_control").cast("double")
    n = n1 + n0
    u = sums.withColumn("u_statistic", F.col("__r1") - n1 * (n1 + 1.0) / 2.0)
    larger = F.greatest(F.col("u_statistic"), n1 * n0 - F.col("u_statistic"))
    spread = F.sqrt(n1 * n0 / 12.0 * ((n + 1.0) - F.try_divide(F.col("__ties"), n * (n - 1.0))))
    z = F.try_divide(larger - n1 * n0 / 2.0 - 0.5, spread)
    # all values tied: the ranks carry no information
    normal_p = F.when(spread > 0, F.least(F.lit(1.0), 2.0 * F.when(z >= 0, dist.normal_upper(z)).otherwise(dist.normal_cdf(-z)))).otherwise(1.0)
    is_exact = F.coalesce(
        (F.least(n1, n0).between(1, EXACT_SMALL_ARM)) & (F.col("__ties") == 0), F.lit(False)
    )
    tested = (n1 > 0) & (n0 > 0)
    # the UDF sees every row, so other rows hand it an empty problem
    sizes = [F.when(is_exact, F.col(c)).otherwise(0) for c in ("n_treated", "n_control")]
    exact_p = _exact_rank_p("u_statistic", *sizes)
    return u.select(
        "n_treated", "n_control", "median_treated", "median_control", "u_statistic",
        F.when(is_exact, exact_p).when(tested, normal_p).alias("p_value"),  # NULL without both arms
    )


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency counts in long form."""
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(
        F.count(F.lit(1)).alias("n")
    )


def crosstab_wide(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """One row per `row` value, one count column per listed value."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def chi_square_by(
    df: DataFrame, row: str, column: str, strata: Sequence[str] = (), yates: bool = True
) -> DataFrame:
    """Independence test per stratum: chi2, df. Works on the contingency table, not on rows."""
    counts = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*strata, row, column).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )

    def over(*extra: str):
        return Window.partitionBy(*strata, *extra)

    margins = counts.select(
        "*",
        F.sum("n").over(over(row)).alias("r"),
        F.sum("n").over(over(column)).alias("c"),
        F.sum("n").over(over()).alias("total"),
        # 1 on the first cell of each row / column of the table
        F.when(F.row_number().over(over(row).orderBy(column)) == 1, 1).otherwise(0).alias("new_row"),
        F.when(F.row_number().over(over(column).orderBy(row)) == 1, 1).otherwise(0).alias("new_column"),
    )
    expected = F.col("r") * F.col("c") / F.col("total")
    sums = margins.groupBy(*strata).agg(
        F.max("total").alias("n"),
        F.sum("new_row").alias("rows"), F.sum("new_column").alias("columns"),
        (F.sum(F.col("n") * F.col("n") / expected) - F.max("total")).alias("pearson"),
        F.max(F.abs(F.col("n") - expected)).alias("gap"),
        F.sum(F.when(F.col("new_row") == 1, 1.0 / F.col("r"))).alias("inverse_rows"),
        F.sum(F.when(F.col("new_column") == 1, 1.0 / F.col("c"))).alias("inverse_columns"),
    )
    freedom = (F.col("rows") - 1) * (F.col("columns") - 1)
    shrunk = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    corrected = shrunk * shrunk * F.col("n") * F.col("inverse_rows") * F.col("inverse_columns")
    statistic = F.when((freedom == 1) & F.lit(yates), corrected).otherwise(F.greatest(F.col("pearson"), F.lit(0.0)))
    return sums.select(
        *strata, F.col("n").cast("bigint").alias("n"),
        F.when(freedom > 0, statistic).otherwise(0.0).alias("chi2"),
        freedom.cast("int").alias("df"),
    )


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Independence of two categorical columns; Yates correction only for a 2×2 table."""
    return chi_square_by(df, row, column).withColumn("p_value", _chi_p())


def _chi_p() -> Column:
    return F.when(F.col("df") > 0, dist.chi_square_upper("chi2", "df")).otherwise(1.0)


def stratified_independence(df: DataFrame, x: str, y: str, strata: Sequence[str]) -> DataFrame:
    """x ⊥ y given the strata: per-stratum chi-squares and degrees of freedom, summed."""
    per_stratum = chi_square_by(df, x, y, strata, yates=False).where(F.col("df") > 0)
    summed = per_stratum.agg(
        F.count(F.lit(1)).alias("n_strata"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("chi2"), F.lit(0.0)).alias("chi2"),
        F.coalesce(F.sum("df"), F.lit(0)).cast("int").alias("df"),
    )
    return summed.withColumn("p_value", _chi_p())


def report_line(name: Column, effect: Column, low: Column, high: Column, p: Column, threshold: float = 0.05) -> Column:
    """`name  effect=…  95% CI=[…]  p=… *`; the star marks p below the threshold."""
    star = F.when(p < threshold, "*").otherwise(" ")
    return F.format_string(
        "%-24s effect=%+.4f   95%% CI=[%+.4f, %+.4f]   p=%.4f %s", name, effect, low, high, p, star
    )


def long_result(result: DataFrame, test: str, outcome: str) -> DataFrame:
    """One-row result → rows `test, outcome, metric, value`."""
    doubles = result.select(*[F.col(c).cast("double").alias(c) for c in result.columns])
    melted = doubles.unpivot([], doubles.columns, "metric", "value")
    return melted.select(F.lit(test).alias("test"), F.lit(outcome).alias("outcome"), "metric", "value")
