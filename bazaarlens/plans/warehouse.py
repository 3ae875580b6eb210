"""The warehouse as wired functions: raw tables → bronze → silver → gold → analytics.

`Warehouse` is lazy: each property is a plan over the raw tables. `run_layers` stores the
tables layer by layer and makes later layers read what was stored.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.operators import analytics, cleaning, facts, quality
from bazaarlens.operators.ordered import ROWS_PER_SLICE
from bazaarlens.session import store_rows
from bazaarlens.sources.raw import read_all_raw
from bazaarlens.sources.tables import LAYERS, read_table, save_bucketed, save_layer


# What the frames read of orders and roll-ups.
STORED_COLUMNS = (
    "order_id", "customer_unique_id", "order_purchase_timestamp", "purchase_week",
    "is_delivered", "is_on_time", "payment_total", "items_subtotal", "dominant_category", "review_score",
)


class Warehouse:
    """Lazy silver, gold and analytics tables over nine raw tables.

    `line_order` names the columns that order the lines of an order; raw marketplace data
    has unique line numbers.
    """

    def __init__(
        self,
        raw: Mapping[str, DataFrame],
        line_order: Sequence[str] = ("order_item_id",),
        lines: DataFrame | None = None,
        translate: bool = True,
        rows_per_slice: int = ROWS_PER_SLICE,
    ):
        self.raw = raw
        self.line_order = tuple(line_order)
        self._lines = lines
        self.translate = translate
        self.rows_per_slice = rows_per_slice

    @property
    def lines(self) -> DataFrame:
        return self.raw["order_items"] if self._lines is None else self._lines

    # ---- silver
    @cached_property
    def customers(self) -> DataFrame:
        return cleaning.customers_first_address(self.raw["customers"], self.raw["orders"])

    @cached_property
    def customer_orders(self) -> DataFrame:
        return cleaning.customer_orders_bridge(self.raw["customers"])

    @cached_property
    def geolocation(self) -> DataFrame:
        return cleaning.geolocation_centroids(self.raw["geolocation"])

    @cached_property
    def products(self) -> DataFrame:
        dictionary = self.raw["category_translation"] if self.translate else None
        return cleaning.products_clean(self.raw["products"], dictionary)

    @cached_property
    def sellers(self) -> DataFrame:
        return cleaning.sellers_located(self.raw["sellers"], self.geolocation)

    @cached_property
    def orders(self) -> DataFrame:
        return cleaning.orders_enriched(self.raw["orders"], self.customer_orders)

    @cached_property
    def order_items(self) -> DataFrame:
        return cleaning.items_enriched(self.raw["order_items"], self.products, self.sellers)

    @cached_property
    def order_lines(self) -> DataFrame:
        """Order items without the seller's state, which no roll-up reads."""
        return cleaning.items_labelled(self.raw["order_items"], self.products)

    @cached_property
    def order_payments(self) -> DataFrame:
        return cleaning.payments_clean(self.raw["order_payments"])

    @cached_property
    def order_reviews(self) -> DataFrame:
        return cleaning.reviews_latest(self.raw["order_reviews"])

    # ---- gold
    @cached_property
    def order_rollups(self) -> DataFrame:
        """The facts that models read, without the customer sequence."""
        return facts.order_rollups(
            self.orders, self.raw["order_payments"], self.order_lines, self.order_reviews, facts.MODEL_COLUMNS
        )

    def stored_rollups(self, *more: str) -> DataFrame:
        """The columns of the same that frames read, `more` of them, and the first line's seller, stored at the first call.

        For queries that read it more than once: the lines are dealt by order for this one table,
        and the tables made from it read the stored one.
        """
        if "rollups_stored" not in self.__dict__:
            rolled = self.order_rollups.select(*STORED_COLUMNS, *more)
            self.replace("order_rollups", store_rows(rolled.join(self.anchors, "order_id", "left"), "rollups"))
            self.rollups_stored = True
        return self.order_rollups

    @cached_property
    def fact_orders(self) -> DataFrame:
        return facts.fact_orders(
            self.orders, self.raw["order_payments"], self.order_lines, self.order_reviews,
            self.rows_per_slice,
        )

    @cached_property
    def dim_customer(self) -> DataFrame:
        return facts.dim_customer(self.fact_orders, self.customers, self.rows_per_slice)

    @cached_property
    def dim_seller(self) -> DataFrame:
        return facts.dim_seller(
            self.order_lines, self.orders, self.products, self.sellers, self.order_reviews,
            rows_per_slice=self.rows_per_slice,
        )

    # ---- analytics
    @cached_property
    def anchors(self) -> DataFrame:
        return analytics.first_line_sellers(self.lines, self.line_order)

    @cached_property
    def cohort_retention(self) -> DataFrame:
        return analytics.cohort_retention(self.fact_orders)

    @cached_property
    def order_funnel(self) -> DataFrame:
        return analytics.order_funnel(self.orders)

    @cached_property
    def repeat_purchase(self) -> DataFrame:
        return analytics.repeat_purchase(self.fact_orders, rows_per_slice=self.rows_per_slice)

    @cached_property
    def category_seller_panel(self) -> DataFrame:
        return analytics.category_seller_panel(self.fact_orders, self.anchors, self.dim_seller)

    @cached_property
    def quality_diagnostics(self) -> DataFrame:
        return quality.quality_diagnostics(self.fact_orders, self.dim_customer, self.cohort_retention, self.counted)

    @cached_property
    def counted(self) -> dict[str, int]:
        """Offending rows of the gates watched while their tables were stored."""
        return {}

    def store_watched(self, qualified: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Stores a table by `store` and counts its gates in the same pass; later tables read the stored one."""
        name, gates = qualified.split(".")[1], quality.GATES.get(qualified, {})
        df = getattr(self, name)
        watched, seen = quality.watch(df, gates) if gates else (df, None)
        stored = store(watched)
        if seen is not None:
            self.counted.update(quality.watched_counts(seen, gates))
        self.replace(name, stored)
        return stored

    @cached_property
    def repeat_revenue(self) -> DataFrame:
        """Read from stored facts where there are some; else only the columns it needs are rolled up."""
        if "fact_orders" in self.__dict__:
            return analytics.repeat_revenue(self.fact_orders)
        rolled = self.order_rollups
        orders = rolled if "rollups_stored" in self.__dict__ else self.orders
        return analytics.repeat_revenue(facts.with_sequence(rolled, orders, self.rows_per_slice))

    def replace(self, name: str, stored: DataFrame) -> None:
        """Later tables read `stored` instead of recomputing `name`."""
        self.__dict__[name] = stored


# Build order inside each layer; a table reads only tables to its left or of earlier layers.
LAYER_TABLES: dict[str, tuple[str, ...]] = {
    "bronze": (
        "orders", "order_items", "order_payments", "order_reviews", "customers",
        "products", "sellers", "geolocation", "category_translation",
    ),
    "silver": (
        "customers", "customer_orders", "geolocation", "products", "sellers",
        "orders", "order_items", "order_payments", "order_reviews",
    ),
    "gold": ("fact_orders", "dim_customer", "dim_seller"),
    "analytics": (
        "cohort_retention", "order_funnel", "repeat_purchase", "category_seller_panel",
        "quality_diagnostics", "repeat_revenue",
    ),
}


# Keys that later layers join and group by; with buckets they do so without an exchange.
BUCKET_KEYS = {
    "silver.orders": ("order_id",), "silver.order_items": ("order_id",), "silver.order_payments": ("order_id",),
    "silver.order_reviews": ("order_id",), "silver.customers": ("customer_unique_id",),
    "gold.fact_orders": ("customer_unique_id",), "gold.dim_customer": ("customer_unique_id",),
}


def check_layers(layers: Sequence[str] | None) -> list[str]:
    chosen = list(layers or LAYERS)
    unknown = [layer for layer in chosen if layer not in LAYERS]
    if unknown:
        raise ValueError(f"unknown layers {unknown}; valid: {list(LAYERS)}")
    return chosen


def _stored(spark: SparkSession, root: str, upto: str) -> Warehouse:
    """A warehouse whose tables of layers before `upto` come from storage."""
    raw = {name: read_table(spark, root, f"bronze.{name}") for name in LAYER_TABLES["bronze"]}
    house = Warehouse(raw)
    for layer in LAYERS[1 : LAYERS.index(upto)]:
        for name in LAYER_TABLES[layer]:
            house.replace(name, read_table(spark, root, f"{layer}.{name}"))
    if upto in ("gold", "analytics"):
        house._lines = house.order_items
        house.replace("order_lines", house.order_items)
    return house


def run_layers(
    spark: SparkSession,
    root: str,
    raw_dir: str | None = None,
    layers: Sequence[str] | None = None,
    raw: Mapping[str, DataFrame] | None = None,
    log: Callable[[str], None] = print,
    buckets: int | None = None,
) -> dict[str, float]:
    """Build the chosen layers in the order given; stops at the first failure.

    With `buckets` the tables of `BUCKET_KEYS` are dealt into so many buckets by their key.

    Returns seconds per `layer.table`. Bronze reads `raw_dir` (all files are checked
    before any work) or takes the frames of `raw`.
    """
    chosen = check_layers(layers)
    if "bronze" in chosen and raw is None:
        if raw_dir is None:
            raise ValueError("bronze needs raw_dir or raw")
        raw = read_all_raw(spark, raw_dir)
    seconds: dict[str, float] = {}
    counted: dict[str, int] = {}
    for layer in chosen:
        house = None if layer == "bronze" else _stored(spark, root, layer)
        for name in LAYER_TABLES[layer]:
            started = time.perf_counter()
            if layer == "bronze":
                save_layer(raw[name], root, layer, name)
            else:
                house.counted.update(counted)
                keys = BUCKET_KEYS.get(f"{layer}.{name}") if buckets else None

                def keep(df, layer=layer, name=name, keys=keys):
                    return save_bucketed(df, root, layer, name, keys, buckets) if keys else save_layer(df, root, layer, name)

                house.store_watched(f"{layer}.{name}", keep)
                counted.update(house.counted)
            seconds[f"{layer}.{name}"] = time.perf_counter() - started
            log(f"{layer}.{name}: {seconds[f'{layer}.{name}']:.2f}s")
    return seconds


def main(argv: Sequence[str] | None = None) -> None:
    from bazaarlens.session import build_session

    parser = argparse.ArgumentParser(description="Build the warehouse layers.")
    parser.add_argument("layers", nargs="*", help=f"layers in build order, of {', '.join(LAYERS)}; default all")
    parser.add_argument("--raw-dir")
    parser.add_argument("--root", required=True)
    args = parser.parse_args(argv)
    check_layers(args.layers)
    run_layers(build_session(), args.root, args.raw_dir, args.layers or None)


if __name__ == "__main__":
    main()
