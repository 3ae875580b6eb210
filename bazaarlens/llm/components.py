"""Connected components by repeated contraction: no node's neighbours are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import store


def connected_components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node of its component.

    Each round hooks a node to its smallest neighbour if that is smaller, follows such pointers `jumps` times, and replaces
    the edges by those between the pointers reached, until none is left.
    """
    spark = edges.sparkSession
    edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hooks = store(hooks, "hooks")
        for _ in range(jumps):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hooks = hooks.join(up, "root").select("node", F.col("above").alias("root"))
        hooks = store(hooks, "hooks")
        if found is None:
            found = hooks
        else:
            further = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = found.join(further, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        left, right = hooks.toDF("a", "ra"), hooks.toDF("b", "rb")
        edges = store(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges",
        )
    return found if found is not None else spark.createDataFrame([], "node long, root long")
