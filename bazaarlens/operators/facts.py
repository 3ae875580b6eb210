"""Order facts, and the customer and seller dimensions.

Every child table is rolled up to the order before it is joined, so no join fans out.
The per-customer sequence runs on three narrow columns; the wide rows are only ever
partitioned by `order_id`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import calendar as cal
from bazaarlens.functions import expressions as ex
from bazaarlens.operators.ordered import ROWS_PER_SLICE, distributed_ntile, group_sequence, split_crowded
from bazaarlens.session import cut_lineage

PLACED = "order_purchase_timestamp"
# Sums of doubles depend on the order of addition; ranks use them at this many decimals.
MONEY_DECIMALS = 4
# An order of more than some four times as many lines is tallied label by label.
LINES_PER_SAMPLE = 50_000


def _most_frequent(label: str) -> Column:
    """Aggregate over (label, n) rows: the label with the largest n, ties to the smallest label."""
    known = F.when(F.col(label).isNotNull(), F.struct((-F.col("n")).alias("rank"), F.col(label).alias("label")))
    return F.min(known)["label"]


PAYMENT_COLUMNS = ("payment_total", "n_payments", "max_installments", "dominant_payment_type")
ITEM_COLUMNS = (
    "n_items", "n_unique_products", "n_unique_categories", "n_unique_sellers",
    "items_subtotal", "items_freight", "items_revenue", "avg_unit_price", "max_unit_price",
    "dominant_category",
)
ROLLUP_COLUMNS = (*PAYMENT_COLUMNS, *ITEM_COLUMNS, "review_score", "review_lag_days")
# What the modelling frames and panels read of them.
MODEL_COLUMNS = ("payment_total", "n_items", "items_subtotal", "items_freight", "dominant_category", "review_score")


def payment_rollup(payments: DataFrame, columns: Sequence[str] = PAYMENT_COLUMNS) -> DataFrame:
    """Sum, count, largest instalment number and most frequent type per order, or only `columns` of them.

    One grouping by order: types are few, so their counts travel with the sums, and a
    payment is dealt once, after those of its task were added up.
    """
    totals = payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_total"), F.count(F.lit(1)).alias("n_payments"),
        F.max("payment_installments").alias("max_installments"),
        F.mode("payment_type", deterministic=True).alias("dominant_payment_type"),
    )
    return totals.select("order_id", *columns)


def item_rollup(
    items: DataFrame, columns: Sequence[str] = ITEM_COLUMNS, lines_per_sample: int = LINES_PER_SAMPLE
) -> DataFrame:
    """Sums, exact distinct counts and the most frequent category per order, or only `columns` of them.

    Lines are dealt by order once, and each order counts its labels where its lines lie.
    Orders of very many lines would gather too many labels in one task, so they are
    tallied label by label instead; a sample tells them apart, and both ways are exact.
    """
    counted = [c for c in ("product", "seller") if f"n_unique_{c}s" in columns]
    labels = ["category_en", *(f"{c}_id" for c in counted)]
    amounts = {c: F.col(c).cast("double") for c in ("price", "freight_value", "line_revenue")}
    lines = items.select("order_id", *labels, *[c.alias(n) for n, c in amounts.items()])
    # the category may come from a join, so the sample does without it
    few, many = split_crowded(lines, "order_id", [*labels[1:], *amounts], lines_per_sample)
    return (
        _gathered_lines(few.repartition("order_id"), counted)
        .unionByName(_tallied_lines(many, counted))
        .select("order_id", *columns)
    )


def _gathered_lines(lines: DataFrame, counted: Sequence[str]) -> DataFrame:
    """The roll-up of orders whose labels fit one task, in one grouping."""
    unique = {f"n_unique_{c}s": F.collect_set(f"{c}_id") for c in counted}
    unique["n_unique_categories"] = F.collect_set("category_en")
    return lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"), *[F.size(c).cast("bigint").alias(n) for n, c in unique.items()],
        F.sum("price").alias("items_subtotal"), F.sum("freight_value").alias("items_freight"), F.sum("line_revenue").alias("items_revenue"),
        ex.safe_ratio(F.sum("price"), F.count("price")).alias("avg_unit_price"), F.max("price").alias("max_unit_price"),
        F.mode("category_en", deterministic=True).alias("dominant_category"),
    )


def _tallied_lines(lines: DataFrame, counted: Sequence[str]) -> DataFrame:
    """The same for orders of any size.

    Every line leaves a mark for its category (with its amounts) and for each of its
    `counted` labels. Marks are tallied per (order, label) first, which spreads an order
    over its labels; the order then adds up tallies.
    """
    labels = ["category_en", *(f"{c}_id" for c in counted)]
    kinds = {c: lines.schema[c].dataType.simpleString() for c in (*labels, "price", "freight_value", "line_revenue")}

    def mark(kind: str, *names: str) -> Column:
        values = [(F.col(n) if n in names else F.lit(None).cast(kinds[n])).alias(n) for n in kinds]
        return F.struct(F.lit(kind).alias("kind"), *values)

    marks, line = lines, F.lit(True)
    if counted:
        marks = lines.select("order_id", F.inline(F.array(
            mark("category", "category_en", "price", "freight_value", "line_revenue"), *[mark(c, f"{c}_id") for c in counted],
        )))
        labels, line = ["kind", *labels], F.col("kind") == "category"
    tallies = marks.groupBy("order_id", *labels).agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.sum("price").alias("price"),
        F.sum("freight_value").alias("freight"), F.sum("line_revenue").alias("revenue"), F.max("price").alias("top_price"),
    )
    unique = {f"n_unique_{c}s": F.count(f"{c}_id") for c in counted}
    return tallies.groupBy("order_id").agg(
        F.sum(F.when(line, F.col("n"))).alias("n_items"),
        F.count("category_en").alias("n_unique_categories"), *[c.alias(n) for n, c in unique.items()],
        F.sum("price").alias("items_subtotal"), F.sum("freight").alias("items_freight"), F.sum("revenue").alias("items_revenue"),
        ex.safe_ratio(F.sum("price"), F.sum("priced")).alias("avg_unit_price"), F.max("top_price").alias("max_unit_price"),
        _most_frequent("category_en").alias("dominant_category"),
    )


def customer_sequence(orders: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Per order: rank in the customer's history, order total, days since the prior order.

    `customer_first_order_at` is added so that windows after the first order need no self-join.
    """
    ranked = group_sequence(
        orders.select("order_id", "customer_unique_id", PLACED),
        ["customer_unique_id"], [PLACED, "order_id"],
        rank="customer_order_rank", total="customer_total_orders",
        previous={PLACED: "__prior"}, first={PLACED: "customer_first_order_at"},
        rows_per_slice=rows_per_slice,
    )
    return ranked.select(
        "order_id",
        "customer_order_rank", "customer_total_orders",
        cal.boundary_diff("day", "__prior", PLACED).alias("days_since_prior_order"),
        (F.col("customer_order_rank") == 1).alias("is_first_purchase"),
        "customer_first_order_at",
    )


def order_rollups(
    orders: DataFrame, payments: DataFrame, items: DataFrame, reviews: DataFrame, columns: Sequence[str] = ROLLUP_COLUMNS
) -> DataFrame:
    """One row per order with payment, item and review attributes (no customer sequence), or only `columns` of them."""
    review = reviews.select("order_id", "review_score", "review_answer_timestamp")
    lag = cal.boundary_diff("day", "order_delivered_customer_date", "review_answer_timestamp")
    joined = (
        orders.join(payment_rollup(payments, [c for c in PAYMENT_COLUMNS if c in columns]), "order_id", "left")
        .join(item_rollup(items, [c for c in ITEM_COLUMNS if c in columns]), "order_id", "left")
        .join(review, "order_id", "left")
    )
    computed = {"review_lag_days": lag}
    if "payment_total" in columns:
        computed["payment_total"] = ex.zero_if_null("payment_total")
    return joined.withColumns(computed).select(*orders.columns, *columns)


def with_sequence(rolled: DataFrame, orders: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Roll-ups with the place of each order in its customer's history."""
    return rolled.join(customer_sequence(orders, rows_per_slice), "order_id", "left").select(
        *rolled.columns,
        "customer_order_rank", "customer_total_orders", "days_since_prior_order",
        "is_first_purchase", "customer_first_order_at",
    )


def fact_orders(
    orders: DataFrame,
    payments: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per order with every roll-up, the review and the customer sequence."""
    return with_sequence(order_rollups(orders, payments, items, reviews), orders, rows_per_slice)


def customer_lifetime(facts: DataFrame) -> DataFrame:
    """Lifetime totals per customer; an order with unknown punctuality counts as late."""
    on_time = F.when(F.col("is_on_time"), 1.0).otherwise(0.0)
    return facts.groupBy("customer_unique_id").agg(
        F.min(PLACED).alias("first_order_at"),
        F.max(PLACED).alias("last_order_at"),
        cal.month_of(F.min(PLACED)).alias("cohort_month"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("payment_total").alias("lifetime_revenue"),
        F.avg("payment_total").alias("avg_order_value"),
        F.avg("review_score").alias("avg_review_score"),
        F.avg(on_time).alias("pct_on_time"),
    )


def dim_customer(facts: DataFrame, customers: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Customers with lifetime totals, exact spend quartile and first address.

    The totals are stored once: the quartile reads them three times.
    """
    lifetime = cut_lineage(customer_lifetime(facts).withColumn("__money", F.round("lifetime_revenue", MONEY_DECIMALS)))
    banded = distributed_ntile(
        lifetime, ["__money", "customer_unique_id"], 4, "spend_quartile", rows_per_slice
    )
    address = customers.select("customer_unique_id", "first_zip_code_prefix", "first_state", "first_city")
    return banded.join(address, "customer_unique_id", "left").select(
        "customer_unique_id", "first_zip_code_prefix", "first_state", "first_city",
        "first_order_at", "last_order_at", "cohort_month", "n_orders",
        "lifetime_revenue", "avg_order_value", "avg_review_score", "pct_on_time",
        "spend_quartile",
        ex.band_label("spend_quartile", ex.SPEND_TIERS).alias("spend_tier"),
        (F.col("n_orders") >= 2).alias("is_repeat_customer"),
    )


def seller_lifetime(items: DataFrame, orders: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Lifetime totals per seller.

    Lines collapse to (order, seller) while they are partitioned by order, so the count of
    orders is a plain count and the scores stay weighted by lines. The distinct products
    and categories come from the (seller, product) pairs.
    """
    placed = orders.select("order_id", PLACED)
    scored = reviews.select("order_id", "review_score")
    baskets = items.groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("line_revenue").alias("paid_lines"),
        F.sum("line_revenue").alias("revenue"),
    )
    known = baskets.join(placed, "order_id", "inner").join(scored, "order_id", "left")
    score_lines = F.when(F.col("review_score").isNotNull(), F.col("lines"))
    totals = known.groupBy("seller_id").agg(
        F.min(PLACED).alias("first_seen_at"),
        F.max(PLACED).alias("last_seen_at"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("revenue").alias("lifetime_revenue"),
        ex.safe_ratio(F.sum("revenue"), F.sum("paid_lines")).alias("avg_line_revenue"),
        ex.safe_ratio(F.sum(F.col("review_score") * F.col("lines")), F.sum(score_lines))
        .alias("avg_review_score"),
    )
    sold = (
        items.join(placed.select("order_id"), "order_id", "left_semi")
        .select("seller_id", "product_id").distinct()
        .join(products.select("product_id", "category_en"), "product_id", "left")
        .groupBy("seller_id")
        .agg(
            F.count("product_id").alias("n_unique_products"),
            F.count_distinct("category_en").alias("n_unique_categories"),
        )
    )
    sold = sold.withColumnRenamed("seller_id", "__seller")
    return totals.join(sold, totals.seller_id.eqNullSafe(sold["__seller"]), "left").select(
        "seller_id", "first_seen_at", "last_seen_at", "n_orders",
        "n_unique_products", "n_unique_categories",
        "lifetime_revenue", "avg_line_revenue", "avg_review_score",
    )


def with_volume_tier(sellers: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exact volume quartile of sellers, which are stored once for it."""
    tiered = distributed_ntile(cut_lineage(sellers), ["n_orders", "seller_id"], 4, "volume_quartile", rows_per_slice)
    return tiered.withColumn("volume_tier", ex.band_label("volume_quartile", ex.VOLUME_TIERS))


def seller_tiers(items: DataFrame, orders: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Only `seller_id, n_orders, volume_quartile, volume_tier`, for consumers of the tier alone.

    The lines of known orders come first: dealt by order for that join, their pairs need no second deal.
    """
    known = items.select("order_id", "seller_id").join(orders.select("order_id"), "order_id", "left_semi")
    counts = (
        known.distinct()
        .groupBy("seller_id").agg(F.count(F.lit(1)).alias("n_orders"))
    )
    return with_volume_tier(counts, rows_per_slice)


def dim_seller(
    items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    reviews: DataFrame,
    as_of=None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Sellers with lifetime totals and exact volume quartile.

    The default uses the whole history; `as_of` counts only orders placed before that
    moment, so that the tier cannot depend on later outcomes.
    """
    counted = orders if as_of is None else orders.where(F.col(PLACED) < F.lit(as_of))
    places = sellers.select(
        "seller_id", F.col("state").alias("seller_state"),
        F.col("lat").alias("seller_lat"), F.col("lng").alias("seller_lng"),
    )
    tiered = with_volume_tier(seller_lifetime(items, counted, products, reviews), rows_per_slice)
    return tiered.join(places, "seller_id", "left").select(
        "seller_id", "seller_state", "seller_lat", "seller_lng", "first_seen_at", "last_seen_at",
        "n_orders", "n_unique_products", "n_unique_categories", "lifetime_revenue",
        "avg_line_revenue", "avg_review_score", "volume_quartile", "volume_tier",
    )
