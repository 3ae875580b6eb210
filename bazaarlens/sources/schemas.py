"""Raw table schemas, pinned so that nothing is inferred at ingest."""

from __future__ import annotations

from pyspark.sql.types import StructType

# ---- fixed values: raw file patterns and their typed columns------------------------
# zip prefixes are strings so that leading zeros survive
RAW_FILES = {
    "orders": "*_orders_dataset.csv",
    "order_items": "*_order_items_dataset.csv",
    "order_payments": "*_order_payments_dataset.csv",
    "order_reviews": "*_order_reviews_dataset.csv",
    "customers": "*_customers_dataset.csv",
    "products": "*_products_dataset.csv",
    "sellers": "*_sellers_dataset.csv",
    "geolocation": "*_geolocation_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
}

RAW_SCHEMAS = {
    "orders": """
        order_id string, customer_id string, order_status string,
        order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz,
        order_delivered_carrier_date timestamp_ntz,
        order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date timestamp_ntz""",
    "order_items": """
        order_id string, order_item_id int, product_id string, seller_id string,
        shipping_limit_date timestamp_ntz, price double, freight_value double""",
    "order_payments": """
        order_id string, payment_sequential int, payment_type string,
        payment_installments int, payment_value double""",
    "order_reviews": """
        review_id string, order_id string, review_score int,
        review_comment_title string, review_comment_message string,
        review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz""",
    "customers": """
        customer_id string, customer_unique_id string,
        customer_zip_code_prefix string, customer_city string, customer_state string""",
    "products": """
        product_id string, product_category_name string, product_name_lenght int,
        product_description_lenght int, product_photos_qty int, product_weight_g int,
        product_length_cm int, product_height_cm int, product_width_cm int""",
    "sellers": """
        seller_id string, seller_zip_code_prefix string, seller_city string,
        seller_state string""",
    "geolocation": """
        geolocation_zip_code_prefix string, geolocation_lat double,
        geolocation_lng double, geolocation_city string, geolocation_state string""",
    "category_translation": """
        product_category_name string, product_category_name_english string""",
}
# ---------------------------------------------------------------------------------


def raw_schema(name: str) -> StructType:
    return StructType.fromDDL(" ".join(RAW_SCHEMAS[name].split()))
