"""Reading the raw CSV files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.sources.schemas import RAW_FILES, raw_schema


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.globStatus(hadoop_path) is not None and len(fs.globStatus(hadoop_path)) > 0


def require_inputs(spark: SparkSession, raw_dir: str) -> None:
    """One error naming every missing raw file, before any work starts."""
    missing = [f for f in sorted(RAW_FILES.values()) if not _path_exists(spark, f"{raw_dir}/{f}")]
    if missing:
        listing = "\n  - ".join(missing)
        raise FileNotFoundError(f"missing raw files in {raw_dir}:\n  - {listing}")


def read_raw(spark: SparkSession, raw_dir: str, name: str) -> DataFrame:
    """One raw table with its pinned schema; a malformed row fails the read.

    Only the reviews carry line breaks inside quoted fields, so only that file gives up
    the splitting of large files; the others are read in parallel blocks.
    """
    return (
        spark.read.schema(raw_schema(name))
        .option("header", True)
        .option("multiLine", name == "order_reviews")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(f"{raw_dir}/{RAW_FILES[name]}")
    )


def read_all_raw(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    require_inputs(spark, raw_dir)
    return {name: read_raw(spark, raw_dir, name) for name in RAW_FILES}


def row_count_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """`table_name, row_count` for every table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
