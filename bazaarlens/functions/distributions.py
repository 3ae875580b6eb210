"""Distribution tails as JVM-side columns (no Python UDF).

Each function is meant for small result frames: one row per test or per category.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: Abramowitz & Stegun 26.2.17, |error| < 7.5e-8 --------------
PHI_P = 0.2316419
PHI_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
# Stirling series of ln Γ: B_2k / (2k (2k-1))
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
# ------------------------------------------------------------------------------
SQRT_2PI = math.sqrt(2.0 * math.pi)
# exp-sinh nodes of integrals over (0, ∞): place and weight of s = exp(π/2 · sinh u)
_STEP = 1.0 / 24.0
_NODES = [math.exp(math.pi / 2.0 * math.sinh(k * _STEP)) for k in range(-84, 85)]
_WEIGHTS = [_STEP * math.pi / 2.0 * math.cosh(k * _STEP) * s for k, s in zip(range(-84, 85), _NODES, strict=True)]


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_pdf(z) -> Column:
    z = _col(z)
    return F.exp(-z * z / 2.0) / SQRT_2PI


def normal_upper(z) -> Column:
    """P(Z > z) for z ≥ 0."""
    z = _col(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(PHI_P) * z)
    poly = F.lit(PHI_B[-1])
    for b in reversed(PHI_B[:-1]):
        poly = poly * t + F.lit(b)
    return normal_pdf(z) * poly * t


def normal_cdf(z) -> Column:
    z = _col(z)
    tail = normal_upper(F.abs(z))
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def normal_two_sided(z) -> Column:
    z = _col(z)
    # LEAST skips NULLs: an undefined statistic must not turn into p = 1
    return F.when(z.isNotNull(), F.least(F.lit(1.0), F.lit(2.0) * normal_upper(F.abs(z))))


def log_gamma(x) -> Column:
    """ln Γ(x) for x > 0: Stirling series after shifting the argument up by 8."""
    x = _col(x)
    y = x + 8.0
    series = F.lit(0.0)
    for k, coefficient in enumerate(STIRLING):
        series = series + F.lit(coefficient) / F.pow(y, F.lit(2.0 * k + 1.0))
    shifted = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2.0 * math.pi) + series
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return shifted - F.log(product)


def _student_scale(df: Column) -> Column:
    """ln of the density of Student's t at 0; the difference of ln Γ by its series in 1/df, after a shift by 32."""
    y = (df + 32.0) / 2.0 - 0.25
    ratio = F.log(y) / 2.0 + F.lit(1 / 64) / (y * y) - F.lit(5 / 2048) / F.pow(y, F.lit(4.0)) + F.lit(61 / 49152) / F.pow(y, F.lit(6.0))
    for k in range(16):
        ratio = ratio - F.log1p(F.lit(1.0) / (df + 2.0 * k))
    return ratio - F.log(df * math.pi) / 2.0


def student_two_sided(t, df) -> Column:
    """Two-sided p of Student's t with real-valued degrees of freedom: the density beyond |t|, integrated by one rule for all df."""
    t, df = F.abs(_col(t)), _col(df)
    scale = _student_scale(df)

    def density(node: Column) -> Column:
        s = t + node["s"]
        return node["w"] * F.exp(scale - (df + 1.0) / 2.0 * F.log1p(s / df * s))

    nodes = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in zip(_NODES, _WEIGHTS, strict=True)])
    tail = F.aggregate(nodes, F.lit(0.0), lambda total, node: total + density(node))
    return F.when(t.isNotNull() & df.isNotNull(), F.least(F.lit(1.0), tail * 2.0))


def student_critical(df, alpha: float = 0.05) -> Column:
    """Upper alpha/2 point of Student's t: normal expansion in 1/df, then Newton steps on the tail."""
    df = _col(df)
    z = normal_quantile(1.0 - alpha / 2.0)
    expansion = (
        F.lit(z)
        + F.lit((z**3 + z) / 4.0) / df
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96.0) / F.pow(df, F.lit(2.0))
        + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0) / F.pow(df, F.lit(3.0))
    )
    log_scale = _student_scale(df)

    def newton(t: Column, _: Column) -> Column:
        density = F.exp(log_scale - (df + 1.0) / 2.0 * F.log1p(t * t / df))
        # halving protects the first steps at very small df
        return F.greatest(t / 2.0, t + (student_two_sided(t, df) - F.lit(alpha)) / (2.0 * density))

    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), expansion, newton)


def chi_square_upper(x, df) -> Column:
    """P(X > x) for integer df: the finite sum, from its last term down, in logarithms.

    A term is the one after it times (its place, plus one half for odd df) / (x/2).
    """
    x, df = _col(x), _col(df)
    half, shape, odd = x / 2.0, df / 2.0, df % 2 == 1
    count = F.floor(shape).cast("int")

    def add(total: Column, j: Column) -> Column:
        before = F.log((j + F.when(odd, 0.5).otherwise(0.0)) / half) + total
        return F.greatest(before, F.lit(0.0)) + F.log1p(F.exp(-F.abs(before)))

    places = F.when(count >= 2, F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    last = (shape - 1.0) * F.log(half) - half - log_gamma(shape)
    finite = F.when(count >= 1, F.exp(last + F.aggregate(places, F.lit(0.0), add))).otherwise(0.0)
    total = finite + F.when(odd, F.lit(2.0) * normal_upper(F.sqrt(x))).otherwise(0.0)
    return F.when(x <= 0, F.lit(1.0)).when(total.isNotNull(), F.least(F.lit(1.0), total))
