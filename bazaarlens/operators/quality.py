"""Data-quality gates: each check is one row `check_name, status, observed`."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _verdict(name: str, ok: Column, observed: Column) -> list[Column]:
    return [
        F.lit(name).alias("check_name"),
        F.when(ok, "ok").otherwise("FAIL").alias("status"),
        observed.cast("string").alias("observed"),
    ]


def unique_check(df: DataFrame, key: str, name: str) -> DataFrame:
    """As many rows as distinct non-NULL keys; observed = rows. Duplicates are counted per key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(key).alias("keys")
    )
    return totals.select(*_verdict(name, F.col("rows") == F.col("keys"), F.col("rows")))


def fk_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent (a NULL key has none)."""
    return child.join(parent.select(key), key, "left_anti")


def fk_check(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    orphans = fk_orphans(child, parent, key).agg(F.count(F.lit(1)).alias("n"))
    return orphans.select(*_verdict(name, F.col("n") == 0, F.col("n")))


def range_check(
    df: DataFrame, column: str, name: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """No value below `low` or above `high`; observed = offending rows."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    count = df.agg(F.count_if(bad).alias("n"))
    return count.select(*_verdict(name, F.col("n") == 0, F.col("n")))


def reconciliation_check(raw: DataFrame, built: DataFrame, name: str, max_drop: float = 0.01) -> DataFrame:
    """Share of raw rows lost on the way to `built`, below `max_drop`."""
    sides = raw.agg(F.count(F.lit(1)).alias("n_raw"), F.lit(0).cast("bigint").alias("n_built")).unionByName(
        built.agg(F.lit(0).cast("bigint").alias("n_raw"), F.count(F.lit(1)).alias("n_built"))
    )
    totals = sides.agg(F.sum("n_raw").alias("n_raw"), F.sum("n_built").alias("n_built"))
    dropped = F.coalesce(
        F.try_divide((F.col("n_raw") - F.col("n_built")).cast("double"), F.col("n_raw").cast("double")),
        F.lit(0.0),
    )
    return totals.select(*_verdict(name, dropped < max_drop, F.format_string("%.6f", dropped)))


def treated_threshold_check(
    df: DataFrame, treatment: str, subtotal: str, threshold: float, name: str
) -> DataFrame:
    """No treated row below the policy threshold; observed = offending rows."""
    below = (F.col(treatment) == 1) & ~F.coalesce(F.col(subtotal) >= threshold, F.lit(False))
    count = df.agg(F.count_if(below).alias("n"))
    return count.select(*_verdict(name, F.col("n") == 0, F.col("n")))


def stack_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


# ---- fixed values: gates that a table's own writing answers ---------------------------
GATES = {
    "gold.fact_orders": {"fact_orders payment_total >= 0": ("payment_total", 0.0, None)},
    "analytics.cohort_retention": {"cohort_retention rate in [0,1]": ("retention_rate", 0.0, 1.0)},
}
# ---------------------------------------------------------------------------------------


def watch(df: DataFrame, gates: Mapping[str, tuple[str, float | None, float | None]]) -> tuple[DataFrame, Observation]:
    """`df` that counts, whenever it is next written or stored, its rows and each gate's offending rows.

    Gates are `name → (column, low, high)`. The counts come with that pass; no other is made.
    """
    seen = Observation()
    bad = {}
    for at, (column, low, high) in enumerate(gates.values()):
        outside = F.lit(False)
        outside = outside if low is None else outside | F.coalesce(F.col(column) < low, F.lit(False))
        outside = outside if high is None else outside | F.coalesce(F.col(column) > high, F.lit(False))
        bad[f"g{at}"] = F.count_if(outside)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in bad.items()]), seen


def watched_counts(seen: Observation, gates: Mapping[str, tuple]) -> dict[str, int]:
    """Offending rows by gate, after the watched table has been stored."""
    found = seen.get
    return {name: int(found[f"g{at}"]) for at, name in enumerate(gates)}


def watched_checks(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    rows = [(name, "ok" if n == 0 else "FAIL", str(n)) for name, n in counts.items()]
    return spark.createDataFrame(rows, "check_name string, status string, observed string")


def quality_diagnostics(
    facts: DataFrame, customers: DataFrame, retention: DataFrame, counted: Mapping[str, int] | None = None
) -> DataFrame:
    """The five standing gates of the warehouse; `counted` holds the offending rows of range gates watched before."""
    counted = dict(counted or {})
    ranges = []
    for df, gates in zip((facts, retention), GATES.values(), strict=True):
        ranges += [range_check(df, column, name, low, high) for name, (column, low, high) in gates.items() if name not in counted]
    if counted:
        ranges.append(watched_checks(facts.sparkSession, counted))
    return stack_checks(
        unique_check(facts, "order_id", "fact_orders unique on order_id"),
        unique_check(customers, "customer_unique_id", "dim_customer unique on customer_unique_id"),
        fk_check(facts, customers, "customer_unique_id", "fact_orders -> dim_customer FK"),
        *ranges,
    )
