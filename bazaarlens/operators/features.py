"""Treatment definition, modelling frames and panels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import calendar as cal
from bazaarlens.functions import expressions as ex
from bazaarlens.operators.ordered import ROWS_PER_SLICE, global_prefix, group_sequence, median_of_counts
from bazaarlens.session import cut_lineage, store_rows

PLACED = "order_purchase_timestamp"
FACTORS = ("category_en", "seller_volume_tier", "customer_state", "calendar_month")
EPOCH = "1970-01-01"
#: A dictionary of at most this many labels is broadcast (a few MB); beyond it the join is a salted shuffle.
BROADCAST_LABELS, SALTS = 50_000, 16
CELL_KEYS = ("purchase_week", *FACTORS, "eligible")


@dataclass(frozen=True)
class TreatmentSpec:
    """Free shipping from `threshold` on, for orders placed from `cutover` on.

    `cutover` is a date, or a column (for instance a scalar subquery) that yields days
    since the epoch, possibly fractional: the median of an even number of weeks.
    """

    threshold: float = 150.0
    cutover: date | Column | None = None
    grace_weeks: int = 6

    def _cutover_day(self) -> Column:
        if self.cutover is None:
            raise ValueError("cutover must be set before treatment is assigned")
        if isinstance(self.cutover, Column):
            return self.cutover
        return F.lit((self.cutover - date.fromisoformat(EPOCH)).days).cast("double")

    def post(self, week: str = "purchase_week") -> Column:
        after = F.unix_date(week).cast("double") >= self._cutover_day()
        return F.coalesce(after, F.lit(False)).cast("int")

    def eligible(self, subtotal: str = "items_subtotal") -> Column:
        return (ex.known_or_zero(subtotal) >= self.threshold).cast("int")

    def assign(self, week: str = "purchase_week", subtotal: str = "items_subtotal") -> Column:
        """1 iff eligible and post; a NULL or NaN subtotal is never treated."""
        return self.post(week) * self.eligible(subtotal)


def with_anchor(facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Orders with the `seller_id` of their first line; facts stored with it keep theirs."""
    return facts if "seller_id" in facts.columns else facts.join(anchors, "order_id", "left")


def order_covariates(
    facts: DataFrame, customers: DataFrame, anchors: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Orders with customer state and the tier / state of the first line's seller.

    Facts stored for cells and frames lack columns that those do not read, and so do their covariates.
    """
    states = customers.select("customer_unique_id", F.col("first_state").alias("customer_state"))
    tiers = sellers.select(
        "seller_id", F.col("volume_tier").alias("seller_volume_tier"), "seller_state"
    )
    plain = ("payment_total", "items_subtotal", "items_freight", "n_items", "is_delivered", "is_lost", "is_on_time", "review_score")
    month = ["purchase_month"] if "purchase_month" in facts.columns else []
    return (
        with_anchor(facts.where(F.col(PLACED).isNotNull()), anchors)
        .join(tiers, "seller_id", "left")
        .join(states, "customer_unique_id", "left")
        .select(
            "order_id", "customer_unique_id", "purchase_week", *month,
            cal.calendar_month(PLACED).alias("calendar_month"),
            F.col("dominant_category").alias("category_en"),
            *[c for c in plain if c in facts.columns],
            "customer_state", "seller_volume_tier", "seller_state",
        )
    )


def within_grace(df: DataFrame, weeks: int, week: str = "purchase_week", history: DataFrame | None = None) -> DataFrame:
    """Drop the last `weeks` weeks, which had no time to be delivered."""
    latest = (df if history is None else history).agg(F.date_sub(F.max(week), 7 * weeks)).scalar()
    return df.where(F.col(week) <= latest)


def median_week(df: DataFrame, week: str = "purchase_week", weight: str | None = None) -> Column:
    """Row-weighted median week in days since the epoch, as a scalar subquery.

    The exact percentile keeps one counter per distinct week, so its state is tiny. `weight`
    holds the number of rows behind each cell.
    """
    rows = [F.col(weight)] if weight else []
    return df.agg(F.percentile(F.unix_date(week), F.lit(0.5), *rows)).scalar()


def label_dictionary(df: DataFrame, factor: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """`label, code` with codes 0..k-1 in label order; NULL has no code.

    The distinct labels are stored and ranked by a prefix count over slices, so no task and
    no value holds all of them.
    """
    labels = cut_lineage(df.where(F.col(factor).isNotNull()).select(F.col(factor).alias("label")).distinct())
    placed = global_prefix(labels, ["label"], {"code": F.lit(1).cast("bigint")}, rows_per_slice=rows_per_slice)
    return placed.select("label", F.col("code").cast("int").alias("code"))


def attach_codes(
    df: DataFrame, dictionary: DataFrame, label: str, alias: str, broadcast_labels: int = BROADCAST_LABELS, salts: int = SALTS
) -> DataFrame:
    """`df` with the code of its label from `dictionary` (label, code); NULL where there is none.

    A dictionary whose counted labels fit is broadcast. A larger one is shuffled, `salts`
    times, against rows spread by a hash of the whole row, so the rows of a hot label share
    no task.
    """
    stored = cut_lineage(dictionary).select(F.col("label").alias("__label"), F.col("code").alias(alias))
    if stored.count() <= broadcast_labels:
        return df.join(F.broadcast(stored), F.col(label) == F.col("__label"), "left").drop("__label")
    copies = stored.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = df.withColumn("__from", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    same = (F.col(label) == F.col("__label")) & (F.col("__from") == F.col("__to"))
    return spread.join(copies, same, "left").drop("__label", "__from", "__to")


def encode_labels(df: DataFrame, factors: Sequence[str] = FACTORS, source: DataFrame | None = None) -> DataFrame:
    """Add `<factor>_code`: position in the sorted labels, -1 for NULL.

    `source` is a smaller table with the same labels, for instance the cells of `df`.
    """
    for factor in factors:
        code = f"{factor}_code"
        df = attach_codes(df, label_dictionary(df if source is None else source, factor), factor, code)
        df = df.withColumn(code, F.coalesce(code, F.lit(-1)))
    return df


def complete_rows(
    covariates: DataFrame,
    spec: TreatmentSpec,
    drop_missing_category: bool = True,
    history: DataFrame | None = None,
) -> DataFrame:
    """Grace cut-off and removal of rows without the adjustment variables.

    `history` (for instance the plain orders) supplies the last week more cheaply.
    """
    needed = [*(["category_en"] if drop_missing_category else []), "seller_volume_tier", "customer_state"]
    return within_grace(covariates, spec.grace_weeks, history=history).dropna(subset=needed)


def finalise_spec(frame: DataFrame, spec: TreatmentSpec, weight: str | None = None) -> TreatmentSpec:
    """Set the cutover to the median week of the remaining rows, unless it is given."""
    if spec.cutover is not None:
        return spec
    return replace(spec, cutover=median_week(frame, weight=weight))


def modelling_cells(rows: DataFrame, spec: TreatmentSpec) -> DataFrame:
    """Complete rows → counts per (week, factors, eligible).

    Everything but the cutover is in the keys, so the median week, the treatment columns and
    every panel, test and fit over on-time or delivered orders can be read off this table.
    Cells merge by adding up.
    """
    keyed = rows.withColumn("eligible", spec.eligible())
    return keyed.groupBy(*CELL_KEYS).agg(*_panel_sums())


def with_treatment(df: DataFrame, spec: TreatmentSpec) -> DataFrame:
    """`post` and `treatment` of rows or cells that have `eligible` and `purchase_week`."""
    return df.withColumn("post", spec.post()).withColumn("treatment", F.col("eligible") * F.col("post"))


def modelling_frame(
    covariates: DataFrame, spec: TreatmentSpec | None = None, drop_missing_category: bool = True
) -> tuple[DataFrame, TreatmentSpec]:
    """Rows with treatment and factor codes, and the spec with its cutover."""
    rows = complete_rows(covariates, spec or TreatmentSpec(), drop_missing_category)
    final = finalise_spec(rows, spec or TreatmentSpec())
    treated = rows.withColumns(
        {"eligible": final.eligible(), "post": final.post(), "treatment": final.assign()}
    )
    return encode_labels(treated), final


def _panel_sums() -> list[Column]:
    return [
        ex.total(F.lit(1)).alias("n_orders"), ex.total(F.col("is_delivered").cast("int")).alias("n_delivered"),
        ex.total(F.col("is_on_time").cast("int")).alias("n_on_time"),
        F.sum("items_subtotal").alias("subtotal"), F.count("items_subtotal").alias("n_subtotals"),
    ]


def _panel(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if "n_orders" in df.columns:
        added = [ex.total(F.col(c)).alias(c) for c in ("n_orders", "n_delivered", "n_on_time", "n_subtotals")]
        sums = df.groupBy(*keys).agg(*added, F.sum("subtotal").alias("subtotal"))
    else:
        sums = df.groupBy(*keys).agg(*_panel_sums())
    return sums.select(
        *keys, "n_orders", "n_delivered", "n_on_time", ex.safe_ratio("subtotal", "n_subtotals").alias("avg_subtotal")
    )


def panel_naive(frame: DataFrame) -> DataFrame:
    """Sufficient statistics per (category, tier, state, month, treatment), of rows or of their cells."""
    return _panel(frame, [*(f"{f}_code" for f in FACTORS), "treatment"])


def panel_did(frame: DataFrame) -> DataFrame:
    """Sufficient statistics per (category, tier, state, eligible, post), of rows or of their cells."""
    return _panel(frame, [*(f"{f}_code" for f in FACTORS[:3]), "eligible", "post"])


# ---- fixed values: outcomes a panel offers ---------------------------------------
OUTCOMES = ("n_on_time", "n_delivered")
NAIVE_COLUMNS = (
    "category_en_code", "seller_volume_tier_code", "customer_state_code",
    "calendar_month_code", "treatment",
)
DID_COLUMNS = (
    "category_en_code", "seller_volume_tier_code", "customer_state_code", "eligible", "post",
)
# ----------------------------------------------------------------------------------


def require_columns(panel: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in panel.columns]
    if missing:
        raise ValueError(f"panel lacks the columns {missing}")


def select_outcome(panel: DataFrame, keys: Sequence[str], outcome: str = "n_on_time") -> DataFrame:
    """Panel reduced to keys, `trials` and `successes` of the chosen outcome."""
    if outcome not in OUTCOMES:
        raise ValueError(f"unknown outcome {outcome!r}; use one of {list(OUTCOMES)}")
    require_columns(panel, [*keys, "n_orders", outcome])
    return panel.select(*keys, F.col("n_orders").alias("trials"), F.col(outcome).alias("successes"))


def cell_summary(df: DataFrame, score: str | None = None, success: str = "is_on_time", weight: str | None = None) -> DataFrame:
    """2×2 summary by (eligible, post): on-time counts (of rows or finer cells), or the mean of a score."""
    cells = df.groupBy("eligible", "post")
    if score:
        return cells.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias(f"avg_{score}"))
    trials, hits = ex.tally(success, weight)
    sums = cells.agg(ex.total(trials).alias("n"), ex.total(hits).alias("on_time"))
    return sums.withColumn("rate", ex.safe_ratio("on_time", "n"))


def keep_frequent(df: DataFrame, label: str, at_least: int = 50) -> DataFrame:
    """Rows whose label occurs at least `at_least` times (never those without a label)."""
    frequent = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("label").isNotNull() & (F.col("n") >= at_least)
    )
    marked = attach_codes(df, frequent.select("label", F.lit(1).alias("code")), label, "__frequent")
    return marked.where(F.col("__frequent").isNotNull()).drop("__frequent")


def customer_revenue_frame(repeat: DataFrame, spec: TreatmentSpec, at_least: int = 50) -> DataFrame:
    """Customers with first-order treatment, economic repeat flag and log first subtotal, stored once."""
    known = repeat.dropna(subset=["first_category", "first_subtotal"])
    week, subtotal = "first_order_week", "first_subtotal"
    treated = known.withColumns(
        {
            "eligible": spec.eligible(subtotal),
            "post": spec.post(week),
            "treatment": spec.assign(week, subtotal),
            "economic_repeat": ex.economic_repeat("has_repeat", "repeat_revenue"),
            "log_first_subtotal": ex.floored_log(subtotal),
        }
    )
    return keep_frequent(store_rows(treated, "revenue"), "first_category", at_least)


def review_frame(
    facts: DataFrame, anchors: DataFrame, sellers: DataFrame, spec: TreatmentSpec, at_least: int = 50
) -> DataFrame:
    """Delivered, scored, categorised orders with a seller tier; frequent categories only. Stored once."""
    tiers = sellers.select("seller_id", F.col("volume_tier").alias("seller_volume_tier"))
    scored = facts.where(
        F.col("review_score").isNotNull()
        & F.col("dominant_category").isNotNull()
        & F.col("is_delivered")
    )
    # an order without a seller meets no tier
    rows = (
        with_anchor(scored, anchors)
        .select("order_id", "seller_id", "customer_unique_id", "review_score", "payment_total", "items_subtotal",
                "purchase_week", F.col("dominant_category").alias("category_en"), "is_delivered",
                cal.calendar_month(PLACED).alias("calendar_month"))
        .join(tiers.where(F.col("seller_volume_tier").isNotNull()), "seller_id", "inner")
        .drop("seller_id")
    )
    treated = rows.withColumns(
        {
            "eligible": spec.eligible(), "post": spec.post(), "treatment": spec.assign(),
            "score_index": ex.score_index("review_score"),
        }
    )
    return keep_frequent(store_rows(treated, "reviews"), "category_en", at_least)


def stratified_sample(
    df: DataFrame,
    stratum: str,
    key: str,
    max_rows: int,
    seed: int = 0,
    at_least: int = 1,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Exact proportional sample: ⌊max_rows · size / N⌋ rows per stratum, at least `at_least`.

    Rows are drawn by a seeded hash of the key. Nothing is dropped when `max_rows` is 0 or
    the frame is not larger.
    """
    if not max_rows:
        return df
    shuffled = df.withColumn("__draw", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    ranked = group_sequence(
        shuffled, [stratum], ["__draw", key], rank="__rank", total="__size", rows_per_slice=rows_per_slice
    ).withColumn("__all", df.agg(F.count(F.lit(1))).scalar())
    share = F.floor(F.lit(max_rows) * F.col("__size") / F.col("__all"))
    quota = F.greatest(F.lit(at_least), share)
    return ranked.where((F.col("__all") <= max_rows) | (F.col("__rank") <= quota)).select(*df.columns)


def score_shares(df: DataFrame, score: str = "review_score") -> DataFrame:
    """Normalised distribution of the score."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", ex.safe_ratio(F.col("n"), total)).select(score, "n", "share")


def mean_by_treatment(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("treatment").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"avg_{value}"))


def revenue_summary(frame: DataFrame) -> DataFrame:
    """One row: panel size, repeat share, treated / eligible / post counts, mean repeat spend."""
    repeat = F.col("has_repeat")
    return frame.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(repeat).alias("repeaters"),
        F.avg(repeat.cast("double")).alias("repeat_share"),
        F.count_if(F.col("treatment") == 1).alias("treated"),
        F.count_if(F.col("eligible") == 1).alias("eligible"),
        F.count_if(F.col("post") == 1).alias("post"),
        F.count_distinct("first_category").alias("categories"),
        F.avg(F.when(repeat, F.col("repeat_revenue"))).alias("avg_spend_if_repeat"),
    )


def weekly_by_eligibility(facts: DataFrame, threshold: float) -> DataFrame:
    """Weekly on-time rate of eligible and other baskets, over delivered orders."""
    known = facts.where(F.col("is_delivered")).dropna(
        subset=["items_subtotal", "items_freight", "purchase_week"]
    )
    hits = ex.flag_sum("is_on_time")
    return known.groupBy(
        "purchase_week", (F.col("items_subtotal") >= threshold).alias("eligible")
    ).agg(
        F.count(F.lit(1)).alias("n"), hits.alias("on_time"),
        ex.safe_ratio(hits, F.count(F.lit(1))).alias("rate"),
    )


def freight_cells(facts: DataFrame, spec: TreatmentSpec) -> DataFrame:
    """Orders and mean freight / subtotal / payment by (eligible, post)."""
    known = facts.dropna(subset=["items_subtotal", "items_freight", "purchase_week"])
    # flags first: a grouping expression may not hold the scalar subquery of the cutover
    flagged = known.withColumns({"eligible": F.col("items_subtotal") >= spec.threshold, "post": spec.post() == 1})
    return flagged.groupBy("eligible", "post").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.avg("items_freight").alias("avg_freight"),
        F.avg("items_subtotal").alias("avg_subtotal"),
        F.avg("payment_total").alias("avg_payment"),
    )


def value_profile(df: DataFrame, value: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Count, min, max and exact median, from the distinct values and their frequencies."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("times")
    )
    placed = global_prefix(
        counts, ["value"], {"below": "times"}, totals={"below": "total"}, rows_per_slice=rows_per_slice
    )
    return placed.agg(
        F.max("total").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        median_of_counts("value", "times", "below", "total").alias("median"),
    )
