"""Registered queries: every operator over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions import calendar as cal
from bazaarlens.operators import (
    abtest,
    analytics,
    cleaning,
    draws,
    facts,
    features,
    identification,
    mapfit,
    pooling,
    quality,
)
from bazaarlens.operators.ordered import distributed_ntile
from bazaarlens.plans.warehouse import Warehouse
from bazaarlens.sources.binding import SELLER_ORDER, SUBTOTAL_THRESHOLD, StarTables
from bazaarlens.session import cut_lineage, ensure_checkpoint_dir, store_rows
from bazaarlens.sources.raw import row_count_audit
from bazaarlens.sources.tables import save_bucketed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUDGE = 1e-8
SPEC = features.TreatmentSpec(threshold=SUBTOTAL_THRESHOLD)


class Study:
    """The warehouse over one folder, and the modelling frames on top of it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.star = StarTables(spark, folder)
        self.house = Warehouse(
            self.star.raw_tables(), line_order=SELLER_ORDER, lines=self.star.ordered_lines, translate=False,
        )

    def keep_orders(self, *more: str) -> DataFrame:
        """Roll-ups for queries that need both the cutover and a frame: the lines are read and dealt once for all."""
        return self.house.stored_rollups(*more)

    @cached_property
    def tiers(self) -> DataFrame:
        """Seller tier and state without the rest of the seller dimension."""
        house = self.house
        states = self.star.sellers.select("seller_id", "seller_state")
        tiers = facts.seller_tiers(self.star.order_items, self.star.orders, house.rows_per_slice)
        return tiers.join(states, "seller_id", "left")

    @cached_property
    def covariates(self) -> DataFrame:
        return features.order_covariates(
            self.house.order_rollups, self.house.customers, self.house.anchors, self.tiers
        )

    def complete(self) -> DataFrame:
        weeks = self.house.raw["orders"].select(cal.week_of(features.PLACED).alias("purchase_week"))
        return features.complete_rows(self.covariates, SPEC, history=weeks)

    @cached_property
    def cells(self) -> DataFrame:
        """The mergeable cell table, stored once: tests, panels and fits read it instead of orders."""
        return cut_lineage(features.modelling_cells(self.complete(), SPEC))

    @cached_property
    def rows(self) -> DataFrame:
        """Stored only for queries that return or bin single orders."""
        return cut_lineage(self.complete())

    @cached_property
    def spec(self) -> features.TreatmentSpec:
        if "rows" in self.__dict__:
            return features.finalise_spec(self.rows, SPEC)
        return features.finalise_spec(self.cells, SPEC, weight="n_orders")

    @cached_property
    def treated(self) -> DataFrame:
        """Complete rows with treatment columns, without label codes."""
        rows = self.rows
        return features.with_treatment(rows.withColumn("eligible", SPEC.eligible()), self.spec)

    @cached_property
    def treated_cells(self) -> DataFrame:
        return features.with_treatment(self.cells, self.spec)

    @cached_property
    def frame(self) -> DataFrame:
        return features.encode_labels(self.treated)

    @cached_property
    def frame_cells(self) -> DataFrame:
        return features.encode_labels(self.treated_cells, source=self.cells)

    @cached_property
    def revenue(self) -> DataFrame:
        self.keep_orders()
        return features.customer_revenue_frame(self.house.repeat_revenue, self.spec)

    @cached_property
    def reviews(self) -> DataFrame:
        rolled = self.keep_orders()
        return features.review_frame(rolled, self.house.anchors, self.tiers, self.spec)


def query(name: str):
    def register(build: Callable[[Study], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Study(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        return build

    return register


def rounded(df: DataFrame, /, **digits: int) -> DataFrame:
    """Round double columns for comparison; `digits` maps a column to its decimals.

    The nudge keeps exact halves (means of 8, 32, … prices) from depending on the last
    bit of a sum; the SQL twins add the same.
    """
    return df.withColumns({c: F.round(F.col(c) + NUDGE, d) for c, d in digits.items()})


def cents(df: DataFrame, column: str) -> DataFrame:
    """Sums compared or ranked by value: rounded first, so that equal amounts tie."""
    return df.withColumn(column, F.round(column, facts.MONEY_DECIMALS))


MONEY = dict(payment_total=4, items_subtotal=4, items_freight=4, items_revenue=4, avg_unit_price=6, max_unit_price=4)


# ---------------------------------------------------------------- silver -----------
@query("row_counts")
def _row_counts(s: Study) -> DataFrame:
    return row_count_audit(s.house.raw)


@query("customers_first_address")
def _customers(s: Study) -> DataFrame:
    return s.house.customers


@query("customer_orders_bridge")
def _bridge(s: Study) -> DataFrame:
    return s.house.customer_orders


@query("geo_centroid_modal")
def _geo(s: Study) -> DataFrame:
    return rounded(s.house.geolocation, lat=6, lng=6)


@query("products_clean")
def _products(s: Study) -> DataFrame:
    return cleaning.products_clean(s.star.products, s.star.category_translation)


@query("sellers_located")
def _sellers(s: Study) -> DataFrame:
    return rounded(s.house.sellers, lat=6, lng=6)


@query("orders_enriched")
def _orders(s: Study) -> DataFrame:
    return s.house.orders


@query("items_enriched")
def _items(s: Study) -> DataFrame:
    items = cleaning.items_enriched(s.star.numbered_items, s.house.products, s.house.sellers)
    return rounded(items, freight_value=4, line_revenue=4)


@query("payments_clean")
def _payments(s: Study) -> DataFrame:
    return rounded(cleaning.payments_clean(s.star.numbered_payments), payment_value=4)


@query("reviews_latest")
def _reviews(s: Study) -> DataFrame:
    return s.house.order_reviews


# ------------------------------------------------------------------ gold -----------
@query("payment_rollup")
def _payment_rollup(s: Study) -> DataFrame:
    return rounded(facts.payment_rollup(s.star.order_payments), payment_total=4)


@query("item_rollup")
def _item_rollup(s: Study) -> DataFrame:
    return rounded(facts.item_rollup(s.house.order_lines), **{k: v for k, v in MONEY.items() if k != "payment_total"})


@query("fact_orders")
def _facts(s: Study) -> DataFrame:
    return rounded(s.house.fact_orders.drop("customer_first_order_at"), **MONEY)


@query("customer_sequence")
def _sequence(s: Study) -> DataFrame:
    return facts.customer_sequence(s.house.orders).drop("customer_first_order_at")


@query("dim_customer")
def _dim_customer(s: Study) -> DataFrame:
    return rounded(
        s.house.dim_customer, lifetime_revenue=4, avg_order_value=6, avg_review_score=6, pct_on_time=6
    )


@query("dim_seller")
def _dim_seller(s: Study) -> DataFrame:
    return rounded(
        s.house.dim_seller, seller_lat=6, seller_lng=6, lifetime_revenue=4, avg_line_revenue=6,
        avg_review_score=6,
    )


@query("dim_seller_as_of")
def _dim_seller_as_of(s: Study) -> DataFrame:
    """Sellers by what they had sold before a moment, so that the tier cannot depend on later orders."""
    house = s.house
    early = facts.dim_seller(
        house.order_lines, house.orders, house.products, house.sellers, house.order_reviews,
        as_of=datetime(1997, 1, 1), rows_per_slice=house.rows_per_slice,
    )
    return rounded(early, seller_lat=6, seller_lng=6, lifetime_revenue=4, avg_line_revenue=6, avg_review_score=6)


@query("ntile_distributed")
def _ntile(s: Study) -> DataFrame:
    totals = s.star.table("orders").select("o_orderkey", "o_totalprice")
    return distributed_ntile(totals, ["o_totalprice", "o_orderkey"], 4, "quartile")


@query("layers_customer_value")
def _layers_customer_value(s: Study) -> DataFrame:
    """Lifetime totals beside the spend of the first half year, from facts stored in buckets of their customer.

    Both groupings and their join read the buckets; nothing but the facts' own writing deals rows by customer.
    """
    spark = s.star.spark
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/layers-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = save_bucketed(s.house.fact_orders, root, "gold", "fact_orders", ["customer_unique_id"], buckets)
    lifetime, repeat = facts.customer_lifetime(stored), analytics.repeat_revenue(stored)
    both = lifetime.join(repeat.drop("first_order_at"), "customer_unique_id").select(
        "customer_unique_id", "n_orders", "lifetime_revenue", "pct_on_time", "first_category", "repeat_revenue", "n_repeat_orders"
    )
    return rounded(both, lifetime_revenue=4, pct_on_time=6, repeat_revenue=4)


# ------------------------------------------------------------- analytics -----------
@query("cohort_retention")
def _retention(s: Study) -> DataFrame:
    return rounded(analytics.cohort_retention(s.house.orders), retention_rate=6)


@query("cohort_retention_spine")
def _retention_spine(s: Study) -> DataFrame:
    return rounded(analytics.cohort_retention(s.house.orders, fill_spine=True), retention_rate=6)


@query("order_funnel")
def _funnel(s: Study) -> DataFrame:
    funnel = s.house.order_funnel
    return rounded(funnel, **{c: 6 for c in funnel.columns if c.startswith(("pct_", "avg_"))})


@query("sessions_orders")
def _sessions(s: Study) -> DataFrame:
    return analytics.repeat_purchase(s.house.orders)


@query("sessions_events")
def _session_events(s: Study) -> DataFrame:
    return analytics.sessionize(s.star.events, ["user_id"], "ts", "event_id", gap_days=1)


@query("repeat_revenue")
def _repeat(s: Study) -> DataFrame:
    return rounded(s.house.repeat_revenue, first_subtotal=4, first_payment_total=4, repeat_revenue=4)


@query("category_seller_panel")
def _panel(s: Study) -> DataFrame:
    panel = analytics.category_seller_panel(s.house.order_rollups, s.house.anchors, s.tiers)
    return rounded(panel, gmv=4, avg_order_value=6, avg_review_score=6, conversion_rate=6)


@query("quality_diagnostics")
def _quality(s: Study) -> DataFrame:
    """Facts and retention are stored once; their range gates are counted while that happens."""
    for name in quality.GATES:
        s.house.store_watched(name, store_rows)
    return s.house.quality_diagnostics


@query("row_reconciliation")
def _reconcile(s: Study) -> DataFrame:
    return quality.reconciliation_check(
        s.star.orders, s.house.fact_orders, "raw orders kept in fact_orders"
    )


@query("treated_threshold")
def _treated_check(s: Study) -> DataFrame:
    return quality.treated_threshold_check(
        s.treated, "treatment", "items_subtotal", SUBTOTAL_THRESHOLD, "no treated order below threshold"
    )


@query("fk_orphans")
def _orphans(s: Study) -> DataFrame:
    """Orders without any order line."""
    return quality.fk_orphans(s.house.orders.select("order_id", "customer_unique_id"), s.star.order_items, "order_id")


# -------------------------------------------------------------- features -----------
@query("order_covariates")
def _covariates(s: Study) -> DataFrame:
    return rounded(s.covariates, payment_total=4, items_subtotal=4, items_freight=4)


@query("treatment_assign")
def _treatment(s: Study) -> DataFrame:
    return s.treated.select("order_id", "eligible", "post", "treatment")


@query("modelling_frame")
def _frame(s: Study) -> DataFrame:
    return rounded(s.frame, items_subtotal=4).select(
        "order_id", "purchase_week", "category_en", "seller_volume_tier", "customer_state",
        "calendar_month", "items_subtotal",
        "is_delivered", "is_on_time", "eligible", "post", "treatment",
        *[f"{f}_code" for f in features.FACTORS],
    )


@query("label_dictionary")
def _labels(s: Study) -> DataFrame:
    return features.label_dictionary(s.star.table("part"), "p_brand")


@query("panel_naive")
def _panel_naive(s: Study) -> DataFrame:
    return rounded(features.panel_naive(s.frame_cells), avg_subtotal=4)


@query("panel_did")
def _panel_did(s: Study) -> DataFrame:
    return rounded(features.panel_did(s.frame_cells), avg_subtotal=4)


@query("panel_outcome_delivered")
def _panel_outcome(s: Study) -> DataFrame:
    return features.select_outcome(features.panel_did(s.frame_cells), features.DID_COLUMNS, "n_delivered")


@query("cell_summary_2x2")
def _cells(s: Study) -> DataFrame:
    return rounded(features.cell_summary(s.treated_cells, success="n_on_time", weight="n_orders"), rate=6)


@query("cell_summary_reviews")
def _cells_reviews(s: Study) -> DataFrame:
    return rounded(features.cell_summary(s.reviews, "review_score"), avg_review_score=6)


@query("keep_frequent")
def _frequent(s: Study) -> DataFrame:
    parts = s.star.table("part").select("p_partkey", "p_size")
    return features.keep_frequent(parts, "p_size", 40)


@query("customer_revenue_frame")
def _revenue(s: Study) -> DataFrame:
    return rounded(
        s.revenue, first_subtotal=4, first_payment_total=4, repeat_revenue=4, log_first_subtotal=6
    )


@query("review_frame")
def _review_frame(s: Study) -> DataFrame:
    return rounded(s.reviews, payment_total=4, items_subtotal=4)


@query("revenue_summary")
def _revenue_summary(s: Study) -> DataFrame:
    return rounded(features.revenue_summary(s.revenue), repeat_share=6, avg_spend_if_repeat=4)


@query("score_shares")
def _shares(s: Study) -> DataFrame:
    return rounded(features.score_shares(s.reviews), share=6)


@query("score_mean_by_treatment")
def _score_mean(s: Study) -> DataFrame:
    return rounded(features.mean_by_treatment(s.reviews, "review_score"), avg_review_score=6)


@query("stratified_sample")
def _sample(s: Study) -> DataFrame:
    orders = s.star.orders.select("order_id", "order_status")
    return features.stratified_sample(orders, "order_status", "order_id", max_rows=3000, seed=0)


@query("weekly_by_eligibility")
def _weekly(s: Study) -> DataFrame:
    return rounded(features.weekly_by_eligibility(s.house.order_rollups, SUBTOTAL_THRESHOLD), rate=6)


@query("freight_cells")
def _freight(s: Study) -> DataFrame:
    cells = features.freight_cells(s.keep_orders("items_freight"), s.spec)
    return rounded(cells, avg_freight=4, avg_subtotal=4, avg_payment=4)


# ------------------------------------------------------------- A/B tests -----------
@query("ab_two_proportion_z")
def _z(s: Study) -> DataFrame:
    result = abtest.two_proportion_z(abtest.arm_counts(s.treated_cells, "n_on_time", weight="n_orders"))
    return rounded(result, **{c: 6 for c in ("rate_treated", "rate_control", "diff", "z", "p_value", "ci_low", "ci_high")})


def _welch_result(s: Study) -> DataFrame:
    return abtest.welch_t(s.revenue, "repeat_revenue")


@query("ab_welch_t")
def _welch(s: Study) -> DataFrame:
    return rounded(
        _welch_result(s), mean_treated=4, mean_control=4, diff=4, t=6, df=4, p_value=5, ci_low=2, ci_high=2
    )


@query("ab_mann_whitney")
def _mann_whitney(s: Study) -> DataFrame:
    result = abtest.mann_whitney(cents(s.revenue, "repeat_revenue"), "repeat_revenue")
    return rounded(result, median_treated=4, median_control=4, u_statistic=1, p_value=6)


@query("ab_mann_whitney_score")
def _mann_whitney_score(s: Study) -> DataFrame:
    result = abtest.mann_whitney(s.reviews, "review_score")
    return rounded(result, median_treated=4, median_control=4, u_statistic=1, p_value=6)


@query("ab_mann_whitney_exact")
def _mann_whitney_exact(s: Study) -> DataFrame:
    """The nations of one region against all others by their customers' balance: an arm small enough for the exact test."""
    nations = s.star.table("nation").select("n_nationkey", "n_regionkey")
    people = s.star.table("customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    arms = people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (F.col("n_regionkey") == 0).cast("int").alias("treatment"), "balance"
    )
    return rounded(abtest.mann_whitney(arms, "balance"), median_treated=4, median_control=4, u_statistic=1, p_value=6)


@query("ab_chi_square")
def _chi(s: Study) -> DataFrame:
    return rounded(abtest.chi_square(s.reviews, "treatment", "review_score"), chi2=6, p_value=6)


@query("ab_crosstab")
def _crosstab(s: Study) -> DataFrame:
    return abtest.crosstab(s.reviews, "treatment", "review_score")


@query("ab_crosstab_wide")
def _crosstab_wide(s: Study) -> DataFrame:
    wide = abtest.crosstab_wide(s.reviews, "treatment", "review_score", [1, 2, 3, 4, 5])
    return wide.withColumnsRenamed({str(k): f"score_{k}" for k in range(1, 6)})


@query("ab_report")
def _report(s: Study) -> DataFrame:
    """Long rows of all five tests, plus the printable line of those with an interval."""
    s.keep_orders()
    z = abtest.two_proportion_z(abtest.arm_counts(s.treated_cells, "n_on_time", weight="n_orders"))
    welch = _welch_result(s)
    parts = [
        abtest.long_result(z.select("diff", "z", "p_value"), "two_proportion_z", "on_time"),
        abtest.long_result(welch.select("diff", "t", "df", "p_value"), "welch_t", "repeat_revenue"),
        abtest.long_result(
            abtest.mann_whitney(cents(s.revenue, "repeat_revenue"), "repeat_revenue").select("u_statistic", "p_value"),
            "mann_whitney", "repeat_revenue",
        ),
        abtest.long_result(
            abtest.chi_square(s.reviews, "treatment", "review_score").select("chi2", "df", "p_value"),
            "chi_square", "review_score",
        ),
        abtest.long_result(
            abtest.mann_whitney(s.reviews, "review_score").select("u_statistic", "p_value"),
            "mann_whitney", "review_score",
        ),
    ]
    return rounded(reduce(DataFrame.unionByName, parts), value=4)


@query("ab_report_lines")
def _report_lines(s: Study) -> DataFrame:
    z = abtest.two_proportion_z(abtest.arm_counts(s.treated_cells, "n_on_time", weight="n_orders"))
    line = abtest.report_line(
        F.lit("on-time (z)"), F.col("diff"), F.col("ci_low"), F.col("ci_high"), F.col("p_value")
    )
    return z.select(line.alias("line"))


# -------------------------------------------------------- identification -----------
DID_DIGITS = {
    **{f"rate_{c}": 6 for c in identification.CELLS},
    "alpha": 6, "beta_eligible": 6, "beta_post": 6, "did_logit": 6, "did_se": 6, "did_pp": 6,
    "z": 6, "p_value": 6,
}


@query("did_saturated")
def _did(s: Study) -> DataFrame:
    counts = identification.cell_counts(s.treated_cells, F.col("n_on_time"), weight="n_orders")
    return rounded(identification.saturated_did(counts), **DID_DIGITS)


@query("naive_vs_did")
def _naive_vs_did(s: Study) -> DataFrame:
    naive = abtest.two_proportion_z(abtest.arm_counts(s.treated_cells, "n_on_time", weight="n_orders"))
    did = identification.saturated_did(identification.cell_counts(s.treated_cells, F.col("n_on_time"), weight="n_orders"))
    both = identification.naive_vs_did(naive, did)
    return rounded(both, **{c: 6 for c in both.columns})


@query("pre_trend")
def _pre_trend(s: Study) -> DataFrame:
    weekly = features.weekly_by_eligibility(s.keep_orders("items_freight"), SUBTOTAL_THRESHOLD)
    pre = cut_lineage(identification.pre_period(weekly, s.spec.cutover))
    return rounded(identification.pre_trend_test(pre), estimate=5, se=5, p_value=5, aic=3)


HISTOGRAM = dict(low=75_000.0, high=525_000.0, width=12_500.0)
DONUT = 25_000.0


def _subtotals(s: Study) -> DataFrame:
    subtotals = facts.item_rollup(s.house.order_lines).select("items_subtotal")
    return cents(subtotals.where(F.col("items_subtotal") >= 0), "items_subtotal")


@query("histogram")
def _histogram(s: Study) -> DataFrame:
    return identification.histogram(_subtotals(s), "items_subtotal", **HISTOGRAM)


@query("subtotal_profile")
def _profile(s: Study) -> DataFrame:
    return rounded(features.value_profile(_subtotals(s), "items_subtotal"), min=4, max=4, median=4)


@query("bunching")
def _bunching(s: Study) -> DataFrame:
    bins = cut_lineage(identification.histogram(_subtotals(s), "items_subtotal", **HISTOGRAM))
    fitted = identification.bunching_fit(bins, SUBTOTAL_THRESHOLD, DONUT)
    result = identification.bunching_test(fitted, SUBTOTAL_THRESHOLD, HISTOGRAM["width"])
    return rounded(result, predicted_below=3, predicted_above=3, excess=3, z=4)


@query("stratified_independence")
def _independence(s: Study) -> DataFrame:
    """basket ⊥ month and freight ⊥ state, given treatment, category and seller tier."""
    binned = s.treated.withColumns(
        {
            "basket_bin": F.least(F.floor(F.col("items_subtotal") / 100_000), F.lit(4)),
            "freight_bin": F.least(F.floor(F.col("items_freight") / 5_000), F.lit(4)),
        }
    )
    strata = ["treatment", "category_en", "seller_volume_tier"]
    claims = {"basket|month": ("basket_bin", "calendar_month"), "freight|state": ("freight_bin", "customer_state")}
    parts = [
        abtest.stratified_independence(binned, x, y, strata).withColumn("claim", F.lit(claim))
        for claim, (x, y) in claims.items()
    ]
    return rounded(reduce(DataFrame.unionByName, parts), chi2=4, p_value=6)


# ------------------------------------------------------- pooled effects ------------
POOL_DIGITS = {
    c: 6
    for c in ("effect", "variance", "tau2", "mu", "mu_sd", "shrunk", "shrunk_sd", "low", "high", "p_positive")
}


def _did_effects(s: Study) -> DataFrame:
    cells = pooling.outcome_cells(s.treated_cells, "category_en", F.col("n_on_time"), weight="n_orders")
    return pooling.category_did_logit(cells)


@query("category_did")
def _category_did(s: Study) -> DataFrame:
    return rounded(_did_effects(s), effect=6, variance=6)


@query("category_pooled")
def _category_pooled(s: Study) -> DataFrame:
    return rounded(pooling.partial_pool(_did_effects(s)), **POOL_DIGITS)


@query("pooled_mean")
def _pooled_mean(s: Study) -> DataFrame:
    mean = pooling.pooled_mean(pooling.partial_pool(_did_effects(s)))
    return rounded(mean, mu=6, mu_sd=6, tau=6, low=6, high=6, p_positive=6)


@query("category_naive_pooled")
def _naive_pooled(s: Study) -> DataFrame:
    cells = pooling.outcome_cells(s.treated_cells, "category_en", F.col("n_on_time"), ("treatment",), weight="n_orders")
    return rounded(pooling.partial_pool(pooling.category_arm_logit(cells)), **POOL_DIGITS)


@query("hurdle_effects")
def _hurdle(s: Study) -> DataFrame:
    return rounded(pooling.hurdle_effects(s.revenue), **POOL_DIGITS)


@query("ordinal_effects")
def _ordinal(s: Study) -> DataFrame:
    return rounded(pooling.ordinal_effects(s.reviews), **POOL_DIGITS)


@query("ordinal_cutpoints")
def _cutpoints(s: Study) -> DataFrame:
    return rounded(pooling.ordinal_cutpoints(s.reviews), cutpoint=6, gap=6)


@query("prior_sensitivity")
def _prior(s: Study) -> DataFrame:
    table = pooling.prior_sensitivity(_did_effects(s))
    return rounded(table, **{c: 6 for c in ("mu", "mu_sd", "tau", "low", "high", "p_positive", "spread", "spread_pp")})


@query("top_categories")
def _top(s: Study) -> DataFrame:
    """Five best categories for on-time delivery, with probability points at the base rate."""
    ranked = pooling.top_effects(pooling.partial_pool(_did_effects(s)), 5)
    points = pooling.effect_points(ranked, base=0.89)
    return rounded(points.select("rank", "category", "shrunk", "low", "high", "p_positive", "points"),
                   shrunk=6, low=6, high=6, p_positive=6, points=6)


def _four_outcomes(s: Study) -> dict[str, DataFrame]:
    hurdle = cut_lineage(pooling.hurdle_effects(s.revenue))
    return {
        "on_time": pooling.partial_pool(_did_effects(s)),
        "repeat": hurdle.where(F.col("stage") == "repeat"),
        "spend": hurdle.where(F.col("stage") == "spend"),
        "review": pooling.ordinal_effects(s.reviews),
    }


@query("effects_side_by_side")
def _side_by_side(s: Study) -> DataFrame:
    table = pooling.side_by_side(_four_outcomes(s))
    return rounded(table, **{c: 6 for c in table.columns if c != "category"})


@query("category_recommendations")
def _recommendations(s: Study) -> DataFrame:
    """Five best and five worst categories for each of the four outcomes."""
    table = pooling.recommendations({name: cut_lineage(df) for name, df in _four_outcomes(s).items()})
    return rounded(table, shrunk=6, low=6, high=6, p_positive=6, size=6)


@query("rollout_shortlist")
def _shortlist(s: Study) -> DataFrame:
    outcomes = _four_outcomes(s)
    harmed = outcomes.pop("review")
    return pooling.rollout_shortlist(outcomes, harmed, n=5)


@query("cost_benefit")
def _cost_benefit(s: Study) -> DataFrame:
    treated = features.freight_cells(s.keep_orders("items_freight"), s.spec).where(F.col("eligible") & F.col("post"))
    means = pooling.pooled_mean(cut_lineage(pooling.hurdle_effects(s.revenue)), ["stage"])
    base = identification.saturated_did(
        identification.cell_counts(s.revenue, F.col("economic_repeat"))
    ).agg(F.max("alpha")).scalar()
    effects = means.agg(
        F.max(F.when(F.col("stage") == "repeat", F.col("mu"))).alias("repeat_shift"),
        F.max(F.when(F.col("stage") == "spend", F.col("mu"))).alias("spend_shift"),
    ).withColumn("base_logit", base)
    result = identification.cost_benefit(treated, effects)
    return rounded(result, avg_freight=4, avg_payment=4, p_control=6, p_treated=6, spend_multiplier=6, subsidy=2,
                   incremental_gmv=2, incremental_margin=2, net=2, break_even_margin=4)


# ---------------------------------------------------------------- draws ------------
DRAWS = 4000  # 1,000 per chain


def _on_time_cells(s: Study) -> DataFrame:
    return cut_lineage(pooling.outcome_cells(s.treated_cells, "category_en", F.col("n_on_time"), weight="n_orders"))


def _effect_draws(s: Study) -> DataFrame:
    return draws.bootstrap_effects(_on_time_cells(s), DRAWS, seed=0)


@query("bootstrap_effects")
def _bootstrap(s: Study) -> DataFrame:
    return rounded(_effect_draws(s), value=6)


@query("draw_summary")
def _draw_summary(s: Study) -> DataFrame:
    return rounded(draws.summarise_draws(_effect_draws(s)), mean=6, sd=6, p3=6, p97=6, p_positive=6)


@query("draw_hdi")
def _draw_hdi(s: Study) -> DataFrame:
    return rounded(draws.hdi(_effect_draws(s)), hdi_low=6, hdi_high=6)


@query("draw_rhat")
def _draw_rhat(s: Study) -> DataFrame:
    return rounded(draws.rhat(_effect_draws(s)), rhat=6)


@query("draw_ess")
def _draw_ess(s: Study) -> DataFrame:
    return rounded(draws.ess(_effect_draws(s)), ess=4)


def _loglik(s: Study) -> DataFrame:
    cells = _on_time_cells(s)
    return draws.binomial_loglik(cells, draws.bootstrap_cells(cells, DRAWS, seed=1), "did")


@query("waic")
def _waic(s: Study) -> DataFrame:
    return rounded(draws.waic(_loglik(s)), lppd=4, p_waic=4, elpd_waic=4, se=4, elpd_per_cell=4)


@query("loo_truncated")
def _loo(s: Study) -> DataFrame:
    return rounded(draws.loo_truncated(_loglik(s)), lppd=4, p_loo=4, elpd_loo=4, se=4, elpd_per_cell=4)


@query("loo_smoothed")
def _loo_smoothed(s: Study) -> DataFrame:
    return draws.loo_smoothed(_loglik(s))


@query("predictive_check")
def _predictive(s: Study) -> DataFrame:
    cells = _on_time_cells(s)
    check = draws.predictive_rate(cells, draws.bootstrap_cells(cells, DRAWS, seed=2))
    return rounded(check, observed=6, replicated=6, p5=6, p95=6)


@query("predictive_spend")
def _predictive_spend(s: Study) -> DataFrame:
    keys = ["category", "eligible", "post"]
    cells = cut_lineage(pooling.spend_moments(s.revenue).select(*keys, "n", "y"))
    again = draws.bootstrap_counts(cells, keys, ["n"], DRAWS, seed=3)
    return rounded(draws.predictive_mean(cells, again, keys), observed=6, replicated=6)


@query("predictive_scores")
def _predictive_scores(s: Study) -> DataFrame:
    counts = cut_lineage(features.score_shares(s.reviews).select("review_score", "n"))
    again = draws.bootstrap_counts(counts, ["review_score"], ["n"], DRAWS, seed=4)
    return rounded(draws.predictive_shares(counts, again, "review_score"), observed=6, replicated=6)


@query("predictive_limits")
def _predictive_limits(s: Study) -> DataFrame:
    """On-time rate of every category's treated cell against the pooled fit."""
    cells = pooling.outcome_cells(s.treated_cells, "category_en", F.col("n_on_time"), weight="n_orders")
    pooled = pooling.partial_pool(pooling.category_did_logit(cells))
    return rounded(pooling.predictive_limits(pooled, pooling.treated_level(cells)), **LIMITS)


@query("predictive_limits_hurdle")
def _predictive_limits_hurdle(s: Study) -> DataFrame:
    return rounded(pooling.predictive_limits(pooling.hurdle_effects(s.revenue)), **LIMITS)


@query("predictive_limits_scores")
def _predictive_limits_scores(s: Study) -> DataFrame:
    return rounded(pooling.predictive_limits(pooling.ordinal_effects(s.reviews)), **LIMITS)


LIMITS = dict(observed=6, predicted=6, low=6, high=6, z=5)
COMPARED = ["purchase_week", "category_en", "seller_volume_tier", "customer_state", "eligible", "post"]


@query("model_comparison")
def _model_comparison(s: Study) -> DataFrame:
    """The naive and the difference-in-differences rates, each scored on the cells left out."""
    cells = s.treated_cells.groupBy(*COMPARED, "treatment").agg(F.sum("n_orders").alias("trials"), F.sum("n_on_time").alias("successes"))
    models = {"naive": ["category_en", "treatment"], "did": ["category_en", "eligible", "post"]}
    pointwise = cut_lineage(draws.cell_elpd(cells, models, COMPARED))
    return rounded(draws.compare_models(pointwise, COMPARED), elpd=3, se=3, difference=3, difference_se=4)


# -------------------------------------------------------------- MAP fits -----------
ON_TIME_LABELS = {"category": "category_en", "tier": "seller_volume_tier", "state": "customer_state"}
REVIEW_LABELS = {"category": "category_en", "tier": "seller_volume_tier"}
DID, NAIVE = ["eligible", "post"], ["treatment"]


def _on_time_fit_cells(s: Study, naive: bool) -> DataFrame:
    """On-time delivery."""
    if naive:
        return mapfit.binomial_cells(s.treated_cells, F.col("n_on_time"), {**ON_TIME_LABELS, "month": "calendar_month"}, NAIVE, "n_orders")
    return mapfit.with_policy(mapfit.binomial_cells(s.treated_cells, F.col("n_on_time"), ON_TIME_LABELS, DID, "n_orders"))


def _repeat_fit_cells(s: Study, naive: bool) -> DataFrame:
    """Did the customer come back?"""
    cells = mapfit.binomial_cells(s.revenue, F.col("economic_repeat"), {"category": "first_category"}, NAIVE if naive else DID)
    return cells if naive else mapfit.with_policy(cells)


def _spend_fit_cells(s: Study, naive: bool) -> DataFrame:
    """How much did returning customers spend? Moments of the log."""
    positive = s.revenue.where(F.col("economic_repeat") == 1)
    cells = mapfit.gaussian_cells(
        positive, F.log("repeat_revenue"), F.col("log_first_subtotal"), {"category": "first_category"}, NAIVE if naive else DID
    )
    return cells if naive else mapfit.with_policy(cells)


def _review_fit_cells(s: Study, naive: bool) -> DataFrame:
    if naive:
        return mapfit.ordinal_cells(s.reviews, {**REVIEW_LABELS, "month": "calendar_month"}, NAIVE)
    return mapfit.with_policy(mapfit.ordinal_cells(s.reviews, REVIEW_LABELS, DID))


# name of the query → stages of (stage, cells, model)
MAP_FITS = {
    "": [("on_time", _on_time_fit_cells, mapfit.BINOMIAL_DID)],
    "_naive": [("on_time", _on_time_fit_cells, mapfit.BINOMIAL_NAIVE)],
    "_revenue": [("repeat", _repeat_fit_cells, mapfit.REPEAT_DID), ("spend", _spend_fit_cells, mapfit.SPEND_DID)],
    "_revenue_naive": [("repeat", _repeat_fit_cells, mapfit.REPEAT_NAIVE), ("spend", _spend_fit_cells, mapfit.SPEND_NAIVE)],
    "_review": [("review", _review_fit_cells, mapfit.REVIEW_DID)],
    "_review_naive": [("review", _review_fit_cells, mapfit.REVIEW_NAIVE)],
}


def _fitted(s: Study, name: str):
    """(stage, stored cells, model, fit) of one query's stages."""
    for stage, build, model in MAP_FITS[name]:
        cells = cut_lineage(build(s, name.endswith("_naive")))
        yield stage, cells, model, mapfit.map_fit(cells, model)


def _register_map_fit(name: str) -> None:
    @query(f"map_fit{name}")
    def rows(s: Study) -> DataFrame:
        """Coefficients, scales and cutpoints of every stage, with steps and convergence."""
        parts = [fit.parameters.withColumn("stage", F.lit(stage)) for stage, _, _, fit in _fitted(s, name)]
        return reduce(DataFrame.unionByName, parts)

    @query(f"map_certificate{name}")
    def certificate(s: Study) -> DataFrame:
        """Outcome totals behind every coefficient, as seen and as the fit explains them."""
        parts = [mapfit.certificate(cells, model, fit).withColumn("stage", F.lit(stage)) for stage, cells, model, fit in _fitted(s, name)]
        table = rounded(reduce(DataFrame.unionByName, parts), observed=3, explained=3)
        return table.withColumns({c: F.col(c) + F.lit(0.0) for c in ("observed", "explained")})


for _name in MAP_FITS:
    _register_map_fit(_name)
