"""Approximate nearest neighbours by cosine: a forest of random-projection trees searched through one priority queue.

Each tree splits on orthonormal random directions, one per level, at the medians of a bounded sample (`sample_rows`, by
hash); every vector is indexed. A query walks all trees together: one queue, ordered by the distance from the query to a
node's cell (the root of the summed squared margins), gives the next node to open; leaves without vectors are passed over. It ends
when the opened leaves are the share `visit` of all leaves and hold that share of the rows, and those of one tree hold at least
`least` different vectors (all of them, if fewer are stored), so small tables are searched whole. The leaves' vectors are then scored exactly in blocks of bounded size, and the best are scored once more, in double
precision on the original vectors, before the final ranking.

Vectors are divided by their largest component (by size), which leaves every cosine as it is. Those that are equal then form a
class that is indexed and searched once and stands for all its rows; only the smallest ids of a class can rank. Candidates that
tie with the last one kept are kept too. Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, neither do
rows without an id. Rows with the same id and vector count once. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm.common import mix64, ship, slices, store, unpack


#: Scores this close may tie once they are computed in double precision on the vectors themselves.
TIE = 1e-9


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """A block by hash, as ids may all be multiples of one number."""
    return (mix64(ids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


class Forest:
    """Directions (trees, depth, width) and thresholds (trees, inner nodes), nodes in heap order."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.depth = min(depth, width)
        self.directions = np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, : self.depth].T for _ in range(trees)])
        self.thresholds = np.zeros((trees, 2**self.depth - 1))
        for tree in range(trees):
            margins = sample @ self.directions[tree].T
            node = np.zeros(len(sample), dtype=np.int64)
            for level in range(self.depth):
                for inner in range(2**level - 1, 2 ** (level + 1) - 1):
                    here = margins[node == inner, level]
                    self.thresholds[tree, inner] = np.median(here) if len(here) else 0.0
                node = 2 * node + 1 + (margins[:, level] > self.thresholds[tree][node])

    @property
    def leaves(self) -> int:
        return 2**self.depth

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        """Leaf numbers (vectors, trees)."""
        out = np.zeros((len(unit), len(self.directions)), dtype=np.int64)
        for tree, directions in enumerate(self.directions):
            margins = unit @ directions.T
            node = np.zeros(len(unit), dtype=np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (margins[:, level] > self.thresholds[tree][node])
            out[:, tree] = node - (self.leaves - 1)
        return out

    def search(self, unit: np.ndarray, budget: int, rows: float, least: int, counts: list[list[int]]) -> list[tuple[int, int]]:
        """(tree, leaf) of the filled leaves whose cells lie nearest to one vector, over all trees.

        At least `budget` leaves with `rows` rows in all (a row counts once per tree), and `least` rows in one tree.
        """
        margins = (self.directions @ unit).tolist()
        thresholds = self.thresholds_list()
        queue = [(0.0, tree, 0, 0) for tree in range(len(margins))]
        found, inner = [], self.leaves - 1
        met, most = [0] * len(margins), 0
        while queue and (len(found) < budget or sum(met) < rows or most < least):
            cost, tree, level, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree][level] - thresholds[tree][node]
                right = margin > 0
                heapq.heappush(queue, (cost + margin * margin, tree, level + 1, 2 * node + 1 + (not right)))
                node, level = 2 * node + 1 + right, level + 1
            if held := counts[tree][node - inner]:
                found.append((tree, node - inner))
                met[tree] += held
                most = max(most, met[tree])
        return found

    def thresholds_list(self) -> list[list[float]]:
        if not hasattr(self, "_thresholds"):
            self._thresholds = self.thresholds.tolist()
        return self._thresholds


def to_matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector (array of double) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("top", top).select("id", F.zip_with("v", F.array_repeat("top", F.size("v")), lambda x, t: F.try_divide(x, t) + 0.0).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda total, s: total + s)

    def scaled(x):
        top = F.array_max(F.transform(x, F.abs))
        return F.transform(x, lambda s: s / top)

    a, b = scaled(a), scaled(b)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", trees: int = 12,
    depth: int = 8, visit: float = 0.085, sample_rows: int = 20_000, block: int = 4096, seed: int = 11, least: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `queries` (over the key column) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    # k + 1 smallest ids of each class of equal vectors; the limit is applied before the shuffle too
    order = Window.partitionBy("v").orderBy("id")
    members = store(
        rows.select("id", "v").withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1).distinct(), "ann-members"
    )
    classes = members.where("place = 1").select(F.col("id").alias("class"), "v")
    total = classes.count()
    asked = store(
        rows.select(F.col("id").alias(key), "v").where(queries).distinct()
        .join(classes, "v").select(F.col(key).alias("query_id"), "class"), "ann-queries",
    )
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    unit = F.pmod(F.xxhash64("class"), F.lit(1 << 30)) / float(1 << 30)
    sample = classes.where(unit <= min(1.0, sample_rows / total)).toArrow()
    matrix = to_matrix(sample.column("v").combine_chunks() if sample.num_rows else classes.limit(1).toArrow().column("v").combine_chunks())
    forest = Forest(unit_rows(matrix[np.lexsort(matrix.T)]), trees, depth, seed)
    shared = ship(spark, forest)
    searched = classes.join(asked.select("class").distinct(), "class", "left_semi")
    n_asked = searched.count()
    leaf_rows = total / forest.leaves
    index_blocks = max(1, math.ceil(leaf_rows / block))
    query_blocks = max(1, math.ceil(n_asked * visit / block))
    budget = max(trees, round(visit * trees * forest.leaves))
    keep = 2 * k + 2
    least = min(total, max(least, keep))

    def fill(batches):
        f, held = unpack(shared), np.zeros(trees * forest_leaves, np.int64)
        for part in slices(batches, 1024):
            leaf = f.leaf_of(unit_rows(to_matrix(part.column("v")))) + np.arange(trees) * f.leaves
            held += np.bincount(leaf.ravel(), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], ["leaf", "n"])

    forest_leaves = forest.leaves
    counts = np.zeros((trees, forest_leaves), np.int64)
    for r in classes.select("v").mapInArrow(fill, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[divmod(r["leaf"], forest_leaves)] = r["n"]
    counts = counts.tolist()
    places = "leaf int, ib int, qb int, is_query boolean, class long, v array<double>"

    def place(batches):
        f = unpack(shared)
        for part in slices(batches, 1024):
            ids, v = part.column("class").to_numpy(), part.column("v")
            leaf = (f.leaf_of(unit_rows(to_matrix(v))) + np.arange(trees) * f.leaves).ravel()
            row = np.repeat(np.arange(len(ids)), trees)
            yield rows_of(leaf, block_of(ids, index_blocks).repeat(trees), row, ids, v, False)

    def probe(batches):
        f = unpack(shared)
        for part in slices(batches, 64):
            ids, v = part.column("class").to_numpy(), part.column("v")
            found = [f.search(u, budget, visit * trees * total, least, counts) for u in unit_rows(to_matrix(v))]
            leaf = np.array([t * f.leaves + x for places in found for t, x in places])
            row = np.repeat(np.arange(len(ids)), [len(x) for x in found])
            yield rows_of(leaf, block_of(ids, query_blocks)[row], row, ids, v, True)

    def rows_of(leaf, own_block, row, ids, v, is_query):
        """Index rows meet every query block and query rows every index block."""
        other = index_blocks if is_query else query_blocks
        row, leaf, own = np.repeat(row, other), np.repeat(leaf, other), np.repeat(own_block, other)
        far = np.tile(np.arange(other), len(row) // other)
        ib, qb = (far, own) if is_query else (own, far)
        return pa.RecordBatch.from_arrays(
            [pa.array(leaf, pa.int32()), pa.array(ib, pa.int32()), pa.array(qb, pa.int32()),
             pa.array(np.full(len(row), is_query)), pa.array(ids[row], pa.int64()), v.take(pa.array(row))],
            ["leaf", "ib", "qb", "is_query", "class", "v"],
        )

    def score(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        mark = table.column("is_query").to_numpy()
        ids, matrix = table.column("class").to_numpy(), unit_rows(to_matrix(table.column("v").combine_chunks()))
        q, x = np.flatnonzero(mark), np.flatnonzero(~mark)
        out_q, out_x, out_s = [], [], []
        for start in range(0, len(q) if len(x) else 0, 256):
            some = q[start : start + 256]
            scores = matrix[some] @ matrix[x].T
            take = min(keep, len(x))
            last = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
            row, column = np.nonzero(scores >= last[:, None] - TIE)
            out_q.append(ids[some][row])
            out_x.append(ids[x][column])
            out_s.append(scores[row, column])
        cat = [np.concatenate(o) if o else np.zeros(0, t) for o, t in ((out_q, np.int64), (out_x, np.int64), (out_s, np.float64))]
        return pa.table({"query": cat[0], "class": cat[1], "near": cat[2]})

    index, probes = classes.mapInArrow(place, places), searched.mapInArrow(probe, places)
    hits = index.unionByName(probes).groupBy("leaf", "ib", "qb").applyInArrow(score, "query long, class long, near double")
    found = hits.groupBy("query", "class").agg(F.max("near").alias("near"))
    first = Window.partitionBy("query").orderBy(F.desc("near"), "class")
    placed = found.withColumn("r", F.row_number().over(first))
    last_kept = placed.where(F.col("r") == keep).select("query", (F.col("near") - TIE).alias("least"))
    pairs = placed.join(last_kept, "query", "left").where((F.col("r") <= keep) | (F.col("near") >= F.col("least"))).select("query", "class")
    left, right = classes.select(F.col("class").alias("query"), F.col("v").alias("qv")), classes
    exact = pairs.join(left, "query").join(right, "class").select("query", "class", cosine(F.col("qv"), F.col("v")).alias("score"))
    member = members.select("v", "id").join(classes, "v").select("class", F.col("id").alias("vec_id"))
    ranked = (
        asked.join(exact.withColumnRenamed("class", "near_class").withColumnRenamed("query", "class"), "class")
        .select("query_id", F.col("near_class").alias("class"), "score").join(member, "class").where("query_id <> vec_id")
    )
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
