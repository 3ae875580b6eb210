"""Binding of the driver's star-schema tables to the raw marketplace tables.

The driver's tables have no delivery stamps, reviews, payments or coordinates; those
columns are derived from the keys with integer arithmetic that any SQL engine repeats.
Every binding reads its whole table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators.ordered import group_sequence

# Parameters that suit these tables (the raw marketplace data uses its own defaults).
SUBTOTAL_THRESHOLD = 275_000.0
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate",
    "l_tax", "l_discount", "l_returnflag", "l_linestatus",
)

# Which seller comes first is settled once lines are ordered as far as the seller itself: lines equal so far have one seller.
SELLER_ORDER = LINE_ORDER[: LINE_ORDER.index("l_suppkey") + 1]

# ---- fixed values: columns of the driver's tables that are read (others are never touched)
STAR_SCHEMAS = {
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
# -----------------------------------------------------------------------------------------


def _hours_after(start: str, hours: Column) -> Column:
    return F.col(start) + F.make_dt_interval(F.lit(0), hours.cast("int"))


def _day_shift(start: str, days: int) -> Column:
    return F.col(start) + F.make_dt_interval(F.lit(days))


@dataclass(frozen=True)
class StarTables:
    """Lazy raw tables over one scale-factor folder."""

    spark: SparkSession
    folder: str
    _read: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """A table with its pinned schema (no job is needed to infer it)."""
        if name not in self._read:
            schema = " ".join(STAR_SCHEMAS[name].split())
            self._read[name] = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    @property
    def orders(self) -> DataFrame:
        k = F.col("o_orderkey")
        stage = k % 40
        shipped_late = stage.isin(0, 1)
        undelivered = stage.isin(0, 1, 2, 3)
        placed = (k * 7) % 24
        status = (
            F.when(stage == 0, "canceled").when(stage == 1, "unavailable")
            .when(stage.isin(2, 3), "shipped").otherwise("delivered")
        )
        day = "o_orderdate"
        return self.table("orders").select(
            k.alias("order_id"),
            F.concat_ws("-", "o_custkey", "o_orderkey").alias("customer_id"),
            status.alias("order_status"),
            _hours_after(day, placed).alias("order_purchase_timestamp"),
            F.when(k % 50 != 0, _hours_after(day, placed + (k * 11) % 72)).alias("order_approved_at"),
            F.when(~shipped_late, _hours_after(day, placed + 72 + (k * 5) % 96))
            .alias("order_delivered_carrier_date"),
            F.when(~undelivered, _hours_after(day, placed + (F.lit(3) + (k * 13) % 29) * 24))
            .alias("order_delivered_customer_date"),
            _day_shift(day, 24).alias("order_estimated_delivery_date"),
        )

    @property
    def customers(self) -> DataFrame:
        """One row per order: the per-order id, the person, and the address."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        people = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        nations = self.table("nation").select("n_nationkey", "n_name")
        return (
            orders.join(people, orders.o_custkey == people.c_custkey)
            .join(nations, people.c_nationkey == nations.n_nationkey)
            .select(
                F.concat_ws("-", "o_custkey", "o_orderkey").alias("customer_id"),
                F.col("o_custkey").alias("customer_unique_id"),
                F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"),
                F.col("c_mktsegment").alias("customer_city"),
                F.col("n_name").alias("customer_state"),
            )
        )

    def _lines(self, *extra: Column) -> list[Column]:
        return [
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
            *extra,
        ]

    @property
    def order_items(self) -> DataFrame:
        """Lines without numbers: enough for every rollup, and free of any sort."""
        return self.table("lineitem").select(*self._lines())

    @property
    def ordered_lines(self) -> DataFrame:
        """Lines with the columns that order them inside an order (see `first_line_sellers`)."""
        return self.table("lineitem").select(*self._lines(*[F.col(c) for c in LINE_ORDER]))

    def _numbered(self, columns: list[str]) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", *dict.fromkeys([*LINE_ORDER, *columns]))
        return group_sequence(lines, ["l_orderkey"], LINE_ORDER, rank="line_no")

    @property
    def numbered_items(self) -> DataFrame:
        """Lines with a unique number per order (the given line numbers repeat)."""
        return self._numbered([]).select(
            *self._lines(F.col("line_no").cast("int").alias("order_item_id"))
        )

    @staticmethod
    def _payment_columns() -> list[Column]:
        price = F.col("l_extendedprice")
        return [
            F.col("l_returnflag").alias("payment_type"),
            F.col("l_quantity").cast("int").alias("payment_installments"),
            (price + price * F.col("l_tax")).alias("payment_value"),
        ]

    @property
    def order_payments(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("order_id"), *self._payment_columns())

    @property
    def numbered_payments(self) -> DataFrame:
        return self._numbered([]).select(
            F.col("l_orderkey").alias("order_id"),
            F.col("line_no").cast("int").alias("payment_sequential"),
            *self._payment_columns(),
        )

    @property
    def order_reviews(self) -> DataFrame:
        """No, one or two versions of a review per order."""
        k = F.col("o_orderkey")

        def version(present: Column, number: int, score: Column, days: int) -> Column:
            return F.when(
                present,
                F.struct(
                    (k * 10 + number).alias("review_id"),
                    (score % 5 + 1).cast("int").alias("review_score"),
                    _day_shift("o_orderdate", days - 2).alias("review_creation_date"),
                    _day_shift("o_orderdate", days).alias("review_answer_timestamp"),
                ),
            )

        versions = F.array_compact(
            F.array(
                version(k % 10 != 0, 0, (k * 31) % 97, 30),
                version(k % 25 == 1, 1, (k * 17) % 89, 33),
            )
        )
        return (
            self.table("orders").select(k.alias("order_id"), F.explode(versions).alias("r"))
            .select("r.review_id", "order_id", "r.review_score", "r.review_creation_date",
                    "r.review_answer_timestamp")
        )

    @property
    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_brand").alias("product_category_name"),
            F.length("p_name").cast("int").alias("product_name_lenght"),
            F.length("p_type").cast("int").alias("product_description_lenght"),
            (size % 6).alias("product_photos_qty"),
            F.when(size % 9 != 0, size * 100).alias("product_weight_g"),
            F.when(size % 10 != 0, size + 2).alias("product_length_cm"),
            F.when(size % 7 != 0, size + 1).alias("product_height_cm"),
            size.alias("product_width_cm"),
        )

    @property
    def category_translation(self) -> DataFrame:
        """Second label of a category; brands ending in 5 have none."""
        return (
            self.table("part").select("p_brand").distinct().where(~F.col("p_brand").endswith("5"))
            .select(
                F.col("p_brand").alias("product_category_name"),
                F.concat(F.lit("category "), F.substring_index("p_brand", "#", -1))
                .alias("product_category_name_english"),
            )
        )

    @property
    def sellers(self) -> DataFrame:
        sellers = self.table("supplier")
        nations = self.table("nation").select("n_nationkey", "n_name")
        return sellers.join(nations, sellers.s_nationkey == nations.n_nationkey).select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"),
            F.col("s_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )

    @property
    def geolocation(self) -> DataFrame:
        people = self.table("customer")
        nations = self.table("nation").select("n_nationkey", "n_name")
        return people.join(nations, people.c_nationkey == nations.n_nationkey).select(
            F.col("c_nationkey").cast("string").alias("geolocation_zip_code_prefix"),
            F.col("c_acctbal").alias("geolocation_lat"),
            (F.col("c_acctbal") * 0.5).alias("geolocation_lng"),
            F.col("c_mktsegment").alias("geolocation_city"),
            F.col("n_name").alias("geolocation_state"),
        )

    @property
    def events(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", "ts")

    def raw_tables(self) -> Mapping[str, DataFrame]:
        return _RawTables(self)


# ---- fixed values: the nine raw tables
RAW_NAMES = (
    "orders", "order_items", "order_payments", "order_reviews", "customers", "products", "sellers",
    "geolocation", "category_translation",
)


class _RawTables(Mapping):
    """The raw tables by name; each is built when it is first asked for."""

    def __init__(self, star: StarTables):
        self._star, self._built = star, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in RAW_NAMES:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = getattr(self._star, name)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(RAW_NAMES)

    def __len__(self) -> int:
        return len(RAW_NAMES)
