"""Cohorts, funnel, sessions, repeat revenue and the category × seller panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import calendar as cal
from bazaarlens.functions import expressions as ex
from bazaarlens.operators.ordered import ROWS_PER_SLICE, gap_sessions, sort_key

PLACED = "order_purchase_timestamp"


def cohort_retention(facts: DataFrame, fill_spine: bool = False) -> DataFrame:
    """Share of each first-order cohort that ordered in each later month.

    A customer's months are a set of calendar months, so the per-customer state is
    bounded by the calendar and one shuffle on the customer is enough. With `fill_spine`
    months without any active customer appear with 0 (up to the last month of the data).
    """
    months = facts.select("customer_unique_id", cal.month_of(PLACED).alias("month"))
    per_customer = months.groupBy("customer_unique_id").agg(
        F.min("month").alias("cohort_month"), F.collect_set("month").alias("months")
    )
    # one row per (cohort, month) plus, under a NULL month, the size of the cohort
    visits = per_customer.select(
        "cohort_month",
        F.explode(F.concat("months", F.array(F.lit(None).cast("date")))).alias("activity_month"),
    )
    counted = visits.groupBy("cohort_month", "activity_month").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.where(F.col("activity_month").isNull()).select(
        "cohort_month", F.col("n").alias("cohort_size")
    )
    active = counted.where(F.col("activity_month").isNotNull()).withColumnRenamed("n", "active_customers")
    if fill_spine:
        last = active.agg(F.max("activity_month")).scalar()
        spine = sizes.withColumn("__last", last).select(
            "cohort_month",
            F.explode(F.sequence("cohort_month", "__last", F.expr("interval 1 month"))).alias("activity_month"),
        )
        active = spine.join(active, ["cohort_month", "activity_month"], "left").withColumn(
            "active_customers", F.coalesce("active_customers", F.lit(0).cast("bigint"))
        )
    return (
        active.join(sizes, "cohort_month")
        .select(
            "cohort_month", "activity_month",
            cal.boundary_diff("month", "cohort_month", "activity_month").alias("month_offset"),
            "cohort_size", "active_customers",
            ex.safe_ratio("active_customers", "cohort_size").alias("retention_rate"),
        )
        .orderBy("cohort_month", "activity_month")
    )


def order_stages(orders: DataFrame) -> DataFrame:
    """Stage flags and hours to each stage, one row per order."""
    stages = {
        "approved": "order_approved_at",
        "carrier": "order_delivered_carrier_date",
        "delivered": "order_delivered_customer_date",
    }
    return orders.select(
        "order_id", "purchase_week", "is_on_time", "is_lost",
        F.lit(True).alias("reached_created"),
        *[F.col(at).isNotNull().alias(f"reached_{name}") for name, at in stages.items()],
        *[cal.boundary_diff("hour", PLACED, at).alias(f"hours_to_{name}") for name, at in stages.items()],
    )


def order_funnel(orders: DataFrame) -> DataFrame:
    """Weekly counts per stage, stage-to-stage conversion, loss rate, mean hours."""
    weekly = order_stages(orders).groupBy("purchase_week").agg(
        ex.flag_sum("reached_created").alias("n_created"),
        ex.flag_sum("reached_approved").alias("n_approved"),
        ex.flag_sum("reached_carrier").alias("n_carrier"),
        ex.flag_sum("reached_delivered").alias("n_delivered"),
        ex.flag_sum("is_on_time").alias("n_on_time"),
        ex.flag_sum("is_lost").alias("n_lost"),
        *[
            F.avg(f"hours_to_{s}").alias(f"avg_hours_to_{s}")
            for s in ("approved", "carrier", "delivered")
        ],
    )
    return weekly.select(
        "purchase_week",
        "n_created", "n_approved", "n_carrier", "n_delivered", "n_on_time", "n_lost",
        ex.safe_ratio("n_approved", "n_created").alias("pct_created_to_approved"),
        ex.safe_ratio("n_carrier", "n_approved").alias("pct_approved_to_carrier"),
        ex.safe_ratio("n_delivered", "n_carrier").alias("pct_carrier_to_delivered"),
        ex.safe_ratio("n_on_time", "n_delivered").alias("pct_delivered_on_time"),
        ex.safe_ratio("n_lost", "n_created").alias("pct_lost"),
        "avg_hours_to_approved", "avg_hours_to_carrier", "avg_hours_to_delivered",
    ).orderBy("purchase_week")


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    gap_days: int = 30,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Sessions split where strictly more than `gap_days` day boundaries lie between rows."""
    gap = cal.boundary_diff("day", "__prior", ts)
    out = gap_sessions(
        df, keys, [ts, tie], F.col("__prior").isNull() | (gap > gap_days),
        previous={ts: "__prior"}, rows_per_slice=rows_per_slice,
    )
    return out.select(
        *df.columns,
        gap.alias("days_since_prior"),
        "session_id", "session_order_rank",
        (F.col("session_order_rank") == 1).alias("is_session_opener"),
    )


def repeat_purchase(facts: DataFrame, gap_days: int = 30, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Order sessions per customer."""
    timeline = facts.select("order_id", "customer_unique_id", PLACED)
    return sessionize(timeline, ["customer_unique_id"], PLACED, "order_id", gap_days, rows_per_slice)


def repeat_revenue(facts: DataFrame, days: int = 180) -> DataFrame:
    """Spend of each customer within `days` after the first order; zeros are kept.

    Facts carry the time of the customer's first order, so the window is a row filter
    that runs at the scan, not a range join.
    """
    first = facts.where(F.col("customer_order_rank") == 1).select(
        "customer_unique_id",
        F.col(PLACED).alias("first_order_at"),
        F.col("purchase_week").alias("first_order_week"),
        F.col("items_subtotal").alias("first_subtotal"),
        F.col("dominant_category").alias("first_category"),
        F.col("payment_total").alias("first_payment_total"),
    )
    returned = (
        facts.where(
            (F.col("customer_order_rank") >= 2)
            & cal.within_days_after(PLACED, "customer_first_order_at", days)
        )
        .groupBy("customer_unique_id")
        .agg(F.sum("payment_total").alias("spent"), F.count(F.lit(1)).alias("times"))
    )
    times = F.coalesce("times", F.lit(0))
    return first.join(returned, "customer_unique_id", "left").select(
        *first.columns,
        F.coalesce("spent", F.lit(0.0)).cast("double").alias("repeat_revenue"),
        times.cast("int").alias("n_repeat_orders"),
        (times > 0).alias("has_repeat"),
    )


def first_line_sellers(items: DataFrame, line_order: Sequence[str] = ("order_item_id",)) -> DataFrame:
    """`order_id, seller_id` of the first line of each order: exactly one row per order."""
    first = F.min_by("seller_id", sort_key(line_order))
    return items.groupBy("order_id").agg(first.alias("seller_id"))


def category_seller_panel(facts: DataFrame, anchors: DataFrame, sellers: DataFrame) -> DataFrame:
    """(week, category, seller tier, seller state) cells; orders without a category are left out."""
    tiers = sellers.select(
        "seller_id", F.col("volume_tier").alias("seller_volume_tier"), "seller_state"
    )
    base = (
        facts.where(F.col("dominant_category").isNotNull())
        .select("order_id", "purchase_week", F.col("dominant_category").alias("category_en"),
                "is_delivered", "is_lost", "is_on_time", "payment_total", "review_score")
        .join(anchors, "order_id", "left")
        .join(tiers, "seller_id", "left")
    )
    return base.groupBy("purchase_week", "category_en", "seller_volume_tier", "seller_state").agg(
        F.count(F.lit(1)).alias("n_orders"),
        ex.flag_sum("is_delivered").alias("n_delivered"),
        ex.flag_sum("is_lost").alias("n_lost"),
        ex.flag_sum("is_on_time").alias("n_on_time"),
        F.sum("payment_total").alias("gmv"),
        F.avg("payment_total").alias("avg_order_value"),
        F.avg(F.col("review_score").cast("double")).alias("avg_review_score"),
        ex.safe_ratio(ex.flag_sum("is_delivered"), F.count(F.lit(1))).alias("conversion_rate"),
        F.lit(False).alias("treatment_assigned"),
    )
