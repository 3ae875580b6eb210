"""Whitening of embedding vectors through distributed block matrices.

A vector entry c counts as the whole number x = floor(`scale` * c) + `shift`. The fit list holds each distinct x vector once; n is
its length, S its sums by dimension, which are exact. Rows are centred in integers before any product, as n * x - S, so a large
common offset costs no digits. The centred rows of the fit list are indexed and dealt into a distributed block matrix; its transpose
times itself gives the scatter, of which only width x width numbers reach the driver. The eigenvectors found there, over the roots
of their eigenvalues, are a small matrix; block matrix times this matrix projects the fit list and all rows.

The products over many row blocks are cut along the inner dimension, so no task holds more than a few blocks. Block coordinates
(one pair per `rows_per_block` rows) are the only thing that grows on the driver.

Vectors that are null, of another length than most (ties: the longer), or that hold null or non-finite entries take no part.
Repeated rows are projected once each and count once in the fit; null ids stay. Directions without variance have no unit scale and
are left out: a single distinct vector, an empty table or vectors without entries give no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import store

SPLIT = 1 << 24  # sums are kept in two parts, so that neither can overflow


def whole_vectors(table: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """key, x of the rows whose vector is complete, finite and of the usual length."""
    entries = F.col(vector)
    finite = F.forall(entries, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = table.where(entries.isNotNull() & finite & (F.size(entries) > 0)).select(F.col(key).alias("key"), F.transform(
        entries, lambda e: F.floor(e.cast("double") * scale).cast("long") + shift
    ).alias("x"))
    usual = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("x") == (usual["width"] if usual else 0))


def number_rows(rows: DataFrame, name: str) -> DataFrame:
    """`rows` stored with a dense `place` from 0: the place in its partition after all earlier partitions."""
    kept = store(rows.withColumn("mark", F.monotonically_increasing_id()), name)
    part = F.shiftright("mark", 33)
    sizes = sorted(kept.groupBy(part.alias("p")).count().collect())  # one row per task
    before, total = {}, 0
    for p, size in sizes:
        before[p], total = total, total + size
    starts = kept.sparkSession.createDataFrame(sorted(before.items()), "part int, first long")
    numbered = kept.withColumn("part", part.cast("int")).join(starts, "part")
    return numbered.withColumn("place", F.col("first") + F.col("mark").bitwiseAND((1 << 33) - 1)).drop("mark", "part", "first")


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of x by dimension."""
    entries = fit.select(F.posexplode("x").alias("d", "v"))
    sums = entries.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.shiftright("v", 24)).alias("h"), F.sum(F.col("v").bitwiseAND(SPLIT - 1)).alias("l"))
    found = {r["d"]: r for r in sums.collect()}  # one row per dimension
    return (found[0]["n"], [found[d]["h"] * SPLIT + found[d]["l"] for d in range(width)]) if found else (0, [])


def longs(values):
    return F.array(*(F.lit(v).cast("long") for v in values))


class Centre:
    """S / n as whole part and remainder, so that n * x - S = n * (x - whole) - rest without loss."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole, self.rest = [s // n for s in sums], [s % n for s in sums]

    def centred(self):
        """x - S / n as doubles."""
        moved = F.zip_with("x", longs(self.whole), lambda x, m: x - m)
        return F.zip_with(moved, F.array(*(F.lit(r / self.n) for r in self.rest)), lambda x, r: x - r)

    def deviation(self):
        """Sum of (n * x - S)^2, exact."""
        moved = F.zip_with("x", longs(self.whole), lambda x, m: (x - m) * F.lit(self.n).cast("long"))
        parts = F.zip_with(moved, longs(self.rest), lambda x, r: (x - r).cast("decimal(19,0)"))
        return F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))


def block_matrix(rows: DataFrame, centre: Centre, rows_per_block: int, width: int) -> BlockMatrix:
    """Centred rows (place, x), indexed and dealt into blocks of whole rows."""
    vectors = rows.select("place", array_to_vector(centre.centred()).alias("v"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"))
    return indexed.toBlockMatrix(rows_per_block, width)


def scatter(matrix: BlockMatrix, blocks: int, width: int) -> np.ndarray:
    """Transpose times matrix, summed over slices of about eight blocks of rows."""
    turned = matrix.transpose()
    slices = max(1, -(-blocks // 8))
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, slices)
    return np.array(BlockMatrix(product, width, width).toLocalMatrix().toArray())


def row_blocks(product: BlockMatrix, rows_per_block: int) -> DataFrame:
    """place, projected (array of doubles) from a one-column block matrix."""

    def rows(item):
        (block, _), values = item
        for i, row in enumerate(values.toArray().tolist()):
            yield block * rows_per_block + i, row

    return product.blocks.flatMap(rows).toDF("place long, projected array<double>")


def whiten(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """Per row and component: key, component, n, deviation (decimal), whitened, explained, identity_error.

    Components come by falling eigenvalue and number at most `components`.
    """
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = whole_vectors(table, key, vector, scale, shift)
    rows = number_rows(vectors, "whiten-rows")
    fit = number_rows(rows.select("x").distinct(), "whiten-fit")
    first = fit.select(F.size("x")).first()
    if not first:
        return spark.createDataFrame([], schema)
    width = first[0]
    n, sums = exact_sums(fit, width)
    centre = Centre(n, sums)
    rows_per_block = int(np.clip((1 << 17) // width, 16, 4096))
    matrix = block_matrix(fit, centre, rows_per_block, width)
    blocks = -(-n // rows_per_block)
    covariance = scatter(matrix, blocks, width) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * width * 1e-14]
    if not len(order):
        return spark.createDataFrame([], schema)
    kept = len(order)
    turn = directions[:, order] / np.sqrt(values[order])
    small = BlockMatrix(
        spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, kept, turn.ravel(order="F").tolist()))], 1), width, kept, width, kept
    )
    whitened_fit = BlockMatrix(matrix.multiply(small)._java_matrix_wrapper._java_model, rows_per_block, kept)
    error = float(np.abs(scatter(whitened_fit, blocks, kept) / n - np.eye(kept)).max())
    projected = row_blocks(block_matrix(rows, centre, rows_per_block, width).multiply(small), rows_per_block)
    explained = F.array(*(F.lit(float(v)) for v in values[order] / np.trace(covariance)))
    out = rows.select("place", "key", centre.deviation().alias("deviation")).join(projected, "place")
    return out.select("key", "deviation", F.posexplode("projected").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
