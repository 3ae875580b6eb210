"""Layered tables and persisted results, as Parquet under one root folder."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

LAYERS = ("bronze", "silver", "gold", "analytics")


def table_path(root: str, layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; valid: {list(LAYERS)}")
    return f"{root}/{layer}/{name}"


def save_layer(df: DataFrame, root: str, layer: str, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write (replacing an earlier build) and return the stored table."""
    path = table_path(root, layer, name)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {bucket_name(path)}")
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def bucket_name(path: str) -> str:
    return f"layer_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def save_bucketed(df: DataFrame, root: str, layer: str, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Like `save_layer`, dealt into `buckets` by a hash of `keys` and sorted by them.

    Grouping by the keys and joining tables bucketed alike then needs no exchange. The rows
    are dealt before writing, so there is one file per bucket. The files are plain Parquet,
    which `read_table` reads too; the buckets are known through the session's catalogue.
    """
    path = table_path(root, layer, name)
    spark, table = df.sparkSession, bucket_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
    dealt.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def read_table(spark: SparkSession, root: str, qualified: str) -> DataFrame:
    """Read `layer.table`, with its buckets if this session wrote it so; readers never lock writers out."""
    layer, _, name = qualified.partition(".")
    path = table_path(root, layer, name)
    table = bucket_name(path)
    return spark.table(table) if spark.catalog.tableExists(table) else spark.read.parquet(path)


def save_panel(df: DataFrame, root: str, name: str) -> DataFrame:
    """Modelling panels and effect tables kept for later steps."""
    path = f"{root}/panels/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_draws(df: DataFrame, root: str, name: str) -> DataFrame:
    """Draws tables `(param, category, chain, draw, value)`, partitioned by parameter."""
    path = f"{root}/draws/{name}"
    df.write.mode("overwrite").partitionBy("param").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_draws(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/draws/{name}")
