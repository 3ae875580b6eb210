"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Words are lower-cased runs of letters and digits; a set holds distinct shingles of `width` words, an item of fewer words
one shingle of its own length (documents are then searched for that length too). Item and document sizes differ by orders of
magnitude, so documents are partitioned by the power of two above their size, and each partition has its own number of
MinHash bins: eight per shingle of its largest set. A bin keeps its smallest hash. An item is hashed into the same number of
bins as the document it meets; one equal bin makes a candidate. A shared shingle is its document's bin minimum with a
probability of at least 0.94, so an item with ten shingles of which eight are shared is missed once in 10^9 cases; items with
fewer shingles keep all of them in their signature, and cannot be missed. Candidates are verified on the shingles themselves.

Null or empty texts, of either side, match nothing. Repeated rows and items are reported once. Rows without doc_id or item_id
take no part. An empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import store, text_or_empty

BINS_LOG2, FEW = 3, 10
#: A broadcast side has at most this many rows of about 40 bytes; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once per row; a plain column would be pasted into lambdas and computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(words: Column, width: int, hashed: bool) -> Column:
    """Distinct shingles of an array of words, as 64-bit hashes or as strings; none if there are fewer words."""

    def of(w: Column) -> Column:
        def body(i: Column) -> Column:
            run = [F.get(w, i + k) for k in range(width)]
            return F.xxhash64(*run) if hashed else F.concat_ws(" ", *run)

        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), body))

    empty = F.array_repeat(F.lit(0).cast("long") if hashed else F.lit(""), 0)
    return let(words, lambda w: F.when(F.size(w) >= width, of(w)).otherwise(empty))


def doc_marks(hashes: Column) -> Column:
    """(h, least, bits) per hash: whether it is the minimum of its bin when the document has 2^bits bins."""

    def of(h: Column) -> Column:
        bits = F.least(F.lit(60), F.ceil(F.log2(F.size(h).cast("double"))).cast("int") + BINS_LOG2)

        def mark(b: Column) -> Column:
            def bin_(x: Column) -> Column:
                return F.call_function("shiftright", x, 64 - b)

            return F.transform(
                h, lambda x, i: F.struct(x.alias("h"), ((i == 0) | (bin_(x) != bin_(F.get(h, i - 1)))).alias("least"), b.alias("bits"))
            )

        return let(bits, mark)

    return let(F.sort_array(hashes), of)


def item_marks(hashes: Column) -> Column:
    """(h, shared, few) per hash: bits shared with the hash before, so it is a bin minimum beyond 2^shared bins."""

    def of(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.struct(
            x.alias("h"), F.when(i == 0, -1).otherwise(64 - F.length(F.bin(x.bitwiseXOR(F.get(h, i - 1))))).alias("shared"),
            (F.size(h) < FEW).alias("few"),
        ))

    return let(F.sort_array(hashes), of)


def guarded(small: DataFrame) -> DataFrame:
    """`small`, stored; with a broadcast hint only if its counted rows allow it."""
    small = store(small, "signature")
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def item_sets(items: DataFrame, width: int) -> DataFrame:
    """item_id, width, its words w."""
    sets = items.where("item_id IS NOT NULL").select("item_id", words_of(text_or_empty()).alias("w")).where("size(w) > 0").distinct()
    return store(sets.withColumn("width", F.least(F.size("w"), F.lit(width))), "items")


def candidates(docs: DataFrame, items: DataFrame, widths: list[int]) -> DataFrame:
    """Distinct (doc_id, item_id) with an equal MinHash bin."""
    out = None
    for width in widths:
        of_items = items.where(F.col("width") == width)
        signature = of_items.select("item_id", F.explode(item_marks(shingles(F.col("w"), width, True))).alias("s")).select("item_id", "s.*")
        marked = docs.select("doc_id", F.explode(doc_marks(shingles(words_of(F.col("t")), width, True))).alias("s")).select("doc_id", "s.*")
        found = marked.join(guarded(signature), "h").where("few OR (least AND shared < bits)").select("doc_id", "item_id")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every item of which a document holds `percent` or more."""
    spark = docs.sparkSession
    sets = item_sets(items, width)
    widths = sorted(r["width"] for r in sets.select("width").distinct().collect())
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_or_empty().alias("t"))
    kind = {f.name: f.dataType.simpleString() for f in (*texts.schema, *sets.schema)}
    if not widths:
        return spark.createDataFrame(
            [], f"doc_id {kind['doc_id']}, item_id {kind['item_id']}, shared long, item_shingles long, containment double"
        )
    pairs = store(candidates(texts, sets, widths), "candidates")
    held = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    matches, sizes = None, None
    for width_ in widths:
        wanted = sets.where(F.col("width") == width_).select("item_id", F.explode(shingles(F.col("w"), width_, False)).alias("shingle"))
        there = held.select("doc_id", F.explode(shingles(words_of(F.col("t")), width_, False)).alias("shingle"))
        found = there.join(guarded(wanted), "shingle").select("doc_id", "item_id", "shingle")
        size = wanted.select("item_id", "shingle")
        matches = found if matches is None else matches.unionByName(found)
        sizes = size if sizes is None else sizes.unionByName(size)
    sizes = sizes.distinct().groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    shared = matches.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return (
        pairs.join(shared, ["doc_id", "item_id"]).join(sizes, "item_id").where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
        .select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))
    )
