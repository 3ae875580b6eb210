"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: order states and tier labels -----------------------------
DELIVERED = "delivered"
LOST_STATES = ("canceled", "unavailable")
SPEND_TIERS = {1: "low", 2: "mid_low", 3: "mid_high", 4: "high"}
VOLUME_TIERS = {1: "small", 2: "mid_small", 3: "mid_large", 4: "large"}
# -----------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """DOUBLE ratio; NULL when the denominator is 0 or NULL."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def null_guarded_product(*factors: Column | str) -> Column:
    """Product as BIGINT, NULL as soon as one factor is NULL."""
    return reduce(lambda a, b: a * b, [_col(f).cast("bigint") for f in factors])


def any_missing(*columns: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [_col(c).isNull() for c in columns])


def is_delivered(status: Column | str) -> Column:
    return _col(status) == DELIVERED


def is_lost(status: Column | str) -> Column:
    return _col(status).isin(*LOST_STATES)


def is_on_time(delivered: Column | str, estimate: Column | str) -> Column:
    """FALSE when undelivered, NULL when delivered without an estimate."""
    return _col(delivered).isNotNull() & (_col(delivered) <= _col(estimate))


def band_label(tile: Column | str, labels: Mapping[int, str]) -> Column:
    tile = _col(tile)
    out = None
    for value, label in labels.items():
        out = (out.when if out is not None else F.when)(tile == value, F.lit(label))
    return out


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0.0))


def flag_sum(flag: Column | str) -> Column:
    """Count of TRUE rows; NULL flags are skipped, and a group of NULL flags only gives NULL."""
    return F.sum(_col(flag).cast("int")).cast("bigint")


def tally(success: Column | str, weight: Column | str | None = None) -> tuple[Column, Column]:
    """Trials and successes of a row: 1 and the flag (NULL: none); of a cell: `weight` and its number of successes."""
    if weight is None:
        return F.lit(1), F.coalesce(_col(success).cast("int"), F.lit(0))
    return _col(weight), _col(success)


def total(value: Column, condition: Column | None = None) -> Column:
    """Sum as BIGINT, of the rows under `condition`; 0 without rows."""
    kept = value if condition is None else F.when(condition, value)
    return F.coalesce(F.sum(kept), F.lit(0)).cast("bigint")


def floored_log(c: Column | str, floor: float = 1.0) -> Column:
    return F.log(F.greatest(_col(c), F.lit(floor)))


def economic_repeat(has_repeat: Column | str, revenue: Column | str) -> Column:
    """1 when the customer came back *and* paid something (cancelled returns do not count)."""
    came_back = F.coalesce(_col(has_repeat), F.lit(False))
    return (came_back & F.coalesce(_col(revenue) > 0, F.lit(False))).cast("int")


def score_index(score: Column | str) -> Column:
    """1..K → 0..K-1."""
    return _col(score).cast("int") - 1


def known_or_zero(c: Column | str) -> Column:
    """NULL and NaN → 0 (NaN would otherwise compare above every threshold)."""
    return F.coalesce(F.nanvl(_col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def logistic(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def logit_to_points(shift: Column | str, base: float) -> Column:
    """Probability-point change that a logit shift makes at the base rate, in percent."""
    import math

    base_logit = math.log(base / (1.0 - base))
    return (logistic(_col(shift) + F.lit(base_logit)) - F.lit(base)) * 100.0
