"""Cleaned tables: one declared grain each, typed, renamed, deduplicated.

Deduplication picks the smallest or largest struct per key, which combines on the map
side, so a key with very many versions never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import calendar as cal
from bazaarlens.functions import expressions as ex

# ---- fixed values: raw product columns (two misspelt) and their clean names -------
PRODUCT_COLUMNS = {
    "product_category_name": "category_pt",
    "product_name_lenght": "name_length",
    "product_description_lenght": "description_length",
    "product_photos_qty": "n_photos",
    "product_weight_g": "weight_g",
    "product_length_cm": "length_cm",
    "product_height_cm": "height_cm",
    "product_width_cm": "width_cm",
}
ADDRESS = {
    "customer_zip_code_prefix": "first_zip_code_prefix",
    "customer_city": "first_city",
    "customer_state": "first_state",
}
# -----------------------------------------------------------------------------------


def customers_first_address(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per person: the address of the earliest order (persons without orders stay)."""
    placed = orders.select("customer_id", "order_purchase_timestamp", "order_id")
    seen = customers.join(placed, "customer_id", "left")
    earliest = F.min(
        F.struct(
            F.col("order_purchase_timestamp").isNull().alias("unknown"),
            F.col("order_purchase_timestamp").alias("at"),
            "order_id",
            *ADDRESS,
        )
    )
    first = seen.groupBy("customer_unique_id").agg(earliest.alias("f"))
    return first.select(
        "customer_unique_id",
        *[F.col(f"f.{raw}").alias(name) for raw, name in ADDRESS.items()],
        F.col("f.at").alias("first_order_at"),
    )


def customer_orders_bridge(customers: DataFrame) -> DataFrame:
    """Per-order shipping id → person and address."""
    return customers.select(
        F.col("customer_id").alias("shipping_id"), "customer_unique_id", *ADDRESS
    )


def geolocation_centroids(geolocation: DataFrame) -> DataFrame:
    """One centroid and one modal (city, state) per zip prefix, in a single pass over the points."""
    zip_, lat, lng, city, state = (
        f"geolocation_{c}" for c in ("zip_code_prefix", "lat", "lng", "city", "state")
    )
    places = geolocation.groupBy(F.col(zip_).alias("zip_prefix"), city, state).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(lat).alias("lat_sum"), F.count(lat).alias("lat_n"),
        F.sum(lng).alias("lng_sum"), F.count(lng).alias("lng_n"),
    )
    most_seen = F.min(
        F.struct(
            (-F.col("n")).alias("rank"),
            F.col(city).isNull().alias("no_city"), F.col(city).alias("city"),
            F.col(state).isNull().alias("no_state"), F.col(state).alias("state"),
        )
    )
    zips = places.groupBy("zip_prefix").agg(
        ex.safe_ratio(F.sum("lat_sum"), F.sum("lat_n")).alias("lat"),
        ex.safe_ratio(F.sum("lng_sum"), F.sum("lng_n")).alias("lng"),
        most_seen.alias("top"),
        F.sum("n").alias("n_observations"),
    )
    return zips.select(
        "zip_prefix", "lat", "lng",
        F.col("top.city").alias("modal_city"), F.col("top.state").alias("modal_state"),
        "n_observations",
    )


def translate_labels(df: DataFrame, label: str, dictionary: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """Add `out`: the dictionary's label, or the original one where there is none."""
    words = dictionary.select(F.col(source).alias("__source"), F.col(target).alias("__target"))
    joined = df.join(words, F.col(label) == F.col("__source"), "left")
    return joined.withColumn(out, F.coalesce("__target", label)).drop("__source", "__target")


def products_clean(products: DataFrame, translation: DataFrame | None = None) -> DataFrame:
    renamed = products.withColumnsRenamed(PRODUCT_COLUMNS)
    if translation is None:
        labelled = renamed.withColumn("category_en", F.col("category_pt"))
    else:
        labelled = translate_labels(
            renamed, "category_pt", translation,
            "product_category_name", "product_category_name_english", "category_en",
        )
    sizes = ("length_cm", "height_cm", "width_cm")
    return labelled.select(
        "product_id", "category_pt", "category_en", "name_length", "description_length",
        "n_photos", "weight_g", *sizes,
        ex.null_guarded_product(*sizes).alias("volume_cm3"),
        ex.any_missing("category_pt", "weight_g", "length_cm").alias("has_missing_attributes"),
    )


def sellers_located(sellers: DataFrame, centroids: DataFrame) -> DataFrame:
    places = centroids.select("zip_prefix", "lat", "lng")
    return sellers.select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("zip_prefix"),
        F.col("seller_city").alias("city"),
        F.col("seller_state").alias("state"),
    ).join(places, "zip_prefix", "left").select("seller_id", "zip_prefix", "city", "state", "lat", "lng")


def orders_enriched(orders: DataFrame, bridge: DataFrame) -> DataFrame:
    """Orders with the person key, time grains, boundary-count lags and status flags."""
    people = bridge.select(F.col("shipping_id").alias("customer_id"), "customer_unique_id")
    placed, delivered = "order_purchase_timestamp", "order_delivered_customer_date"
    estimated = "order_estimated_delivery_date"
    return orders.join(people, "customer_id", "left").select(
        "order_id", "customer_id", "customer_unique_id", "order_status",
        placed, "order_approved_at", "order_delivered_carrier_date", delivered, estimated,
        cal.day_of(placed).alias("purchase_date"),
        cal.week_of(placed).alias("purchase_week"),
        cal.month_of(placed).alias("purchase_month"),
        cal.day_of_week(placed).alias("purchase_dow"),
        cal.hour_of(placed).alias("purchase_hour"),
        cal.boundary_diff("minute", placed, "order_approved_at").alias("approval_lag_minutes"),
        cal.boundary_diff("day", placed, delivered).alias("delivery_days"),
        cal.boundary_diff("day", estimated, delivered).alias("delivery_vs_estimate_days"),
        ex.is_delivered("order_status").alias("is_delivered"),
        ex.is_lost("order_status").alias("is_lost"),
        ex.is_on_time(delivered, estimated).alias("is_on_time"),
    )


def items_labelled(items: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines with category and line revenue: all that the roll-ups read."""
    labels = products.select("product_id", "category_en")
    numbered = ["order_item_id"] if "order_item_id" in items.columns else []
    return items.join(labels, "product_id", "left").select(
        "order_id", *numbered, "product_id", "category_en", "seller_id",
        "shipping_limit_date", "price", "freight_value",
        (F.col("price") + F.col("freight_value")).alias("line_revenue"),
    )


def items_enriched(items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Order lines with category, seller state and line revenue."""
    places = sellers.select("seller_id", F.col("state").alias("seller_state"))
    return items_labelled(items, products).join(places, "seller_id", "left")


def payments_clean(payments: DataFrame) -> DataFrame:
    """Payment records as they are; the order-level roll-up belongs to the facts."""
    return payments.select(
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"
    )


def reviews_latest(reviews: DataFrame) -> DataFrame:
    """One review per order: the latest answer, unanswered versions last, then the larger id."""
    latest = F.max(
        F.struct(
            F.col("review_answer_timestamp").isNotNull().alias("answered"),
            "review_answer_timestamp", "review_id", "review_score", "review_creation_date",
        )
    )
    picked = reviews.groupBy("order_id").agg(latest.alias("r"))
    return picked.select(
        "r.review_id", "order_id", "r.review_score", "r.review_creation_date",
        "r.review_answer_timestamp",
    )
