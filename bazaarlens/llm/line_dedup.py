"""Removal of recurring lines through a log-template tree, in DataFrame operations only.

The tree has a fixed depth: the first level is a line's number of tokens (runs of no white space), the next `depth` levels
are its leading tokens; a token with a digit is a variable field `<*>`. Lines that end in one leaf are generalised position
by position: a token that stands there in fewer than `min_docs` texts is a variable field too. A template recurs if it occurs in
`min_docs` different texts and the share `constant` of its tokens without a digit is constant, at least `words` of them, so
that dates, years and page numbers do not shield a line. A line that stands verbatim in `min_docs` texts recurs whatever its
digits, one of at least `long_tokens` tokens in two. Recurring lines are dropped from all documents but the first (smallest
doc_id) and those with the first one's text. Documents with equal texts count once, so whole copies are no recurrence; they
are the next step's work.

Lines of fewer than `min_tokens` tokens are left alone. A null text is empty. Repeated rows are treated alike. A document
without doc_id is cleaned too, and never the first if another has one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import store, text_or_empty

FIELD = "<*>"
#: The most bits of the filter that lines pass before they are dealt: 8 MB, broadcast. Bits that clash let a line through.
FILTER_BITS = 1 << 26


def tokens_of(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def lines_of(docs: DataFrame, min_tokens: int, depth: int) -> DataFrame:
    """doc_id, content (hash of the text), place, line, leaf (hash of the path in the tree)."""
    texts = docs.select("doc_id", text_or_empty().alias("t"))
    lines = texts.select("doc_id", F.xxhash64("t").alias("content"), F.posexplode(F.split("t", "\n")).alias("place", "line"))
    split = lines.withColumn("tokens", tokens_of(F.col("line"))).where(F.size("tokens") >= min_tokens)
    lead = [masked(F.get("tokens", F.lit(level))) for level in range(depth)]
    size = F.size("tokens")
    return split.select("doc_id", "content", "place", "line", size.alias("n"), F.xxhash64(size, *lead).alias("leaf"))


def likely_in(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = FILTER_BITS) -> DataFrame:
    """The `rows` whose hash `key` is in `keys` (stored), and some others: tested against bitmaps of one bit per hash, sixteen bits a key."""
    bits = min(most_bits, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    spot = F.pmod(F.col(key), F.lit(bits)) + 1
    marks = keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")
    )
    at = F.bitmap_bit_position(spot).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = (F.bitmap_bucket_number(spot) == F.col("bucket")) & (F.getbit(byte, F.pmod(at, F.lit(8))) == 1)
    return rows.join(F.broadcast(marks), met, "left_semi")


def recurring_lines(
    docs: DataFrame, min_docs: int, min_tokens: int, depth: int, constant: float, long_tokens: int, words: int
) -> DataFrame:
    """(doc_id, content, place) of the lines to drop."""
    lines = lines_of(docs, min_tokens, depth).withColumn("line_key", F.xxhash64("line"))

    def enough(tokens: str) -> Column:
        """Texts in which a line of so many tokens must stand verbatim."""
        return F.when(F.col(tokens) >= long_tokens, min(2, min_docs)).otherwise(min_docs)

    # only lines go on that may recur: those of leaves that several texts reach, and long ones that fewer texts share verbatim
    narrow = store(lines.select("leaf", "n", "line_key", "content").distinct(), "line-keys")
    reached = narrow.select("leaf", "content").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    leaves = store(reached, "leaves")
    twice = narrow.where(F.col("n") >= long_tokens).groupBy("leaf", "line_key").count().where(F.col("count") >= min(2, min_docs))
    few = twice.join(leaves, "leaf", "left_anti").groupBy("leaf").agg(F.collect_set("line_key").alias("keys"))
    none = F.lit(None).cast("array<bigint>").alias("keys")
    shared = store(leaves.select("leaf", none).unionByName(few), "leaf-marks")
    # other lines, most of the text, are let go before any is dealt by leaf
    likely = likely_in(lines.drop("n"), shared, "leaf")
    found = store(likely.join(shared, "leaf").where("keys IS NULL OR array_contains(keys, line_key)").drop("keys"), "leaf-lines")
    distinct = found.select("leaf", "line_key", "line", "content").distinct().groupBy("leaf", "line_key").agg(
        F.first("line").alias("line"), F.count("*").alias("texts")
    )
    placed = store(
        distinct.select("leaf", "line_key", "texts", F.posexplode(tokens_of(F.col("line"))).alias("at", "token"))
        .withColumn("token", masked(F.col("token"))), "leaf-tokens",
    )
    support = placed.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("support"))
    fixed = (F.col("support") >= min_docs) & (F.col("token") != FIELD)
    general = placed.join(support, ["leaf", "at", "token"]).select(
        "leaf", "line_key", "texts", "at", (F.col("token") == FIELD).alias("field"), F.when(fixed, F.col("token")).otherwise(FIELD).alias("token"), fixed.cast("int").alias("fixed")
    )
    templates = general.groupBy("leaf", "line_key").agg(
        F.array_sort(F.collect_list(F.struct("at", "token"))).alias("path"),
        F.avg(F.when(~F.col("field"), F.col("fixed"))).alias("word_share"), F.sum("fixed").alias("constants"),
        F.first("texts").alias("texts"), F.count("*").alias("n"),
    )
    by_template = (F.coalesce("word_share", F.lit(0.0)) >= constant) & (F.col("constants") >= words)
    verbatim = (F.col("texts") >= enough("n")) & ~(by_template & (F.col("texts") >= min_docs))
    ways = F.array(
        F.when(by_template, F.struct(F.xxhash64("leaf", "path.token").alias("template"), F.lit(min_docs).alias("least"))),
        F.when(verbatim, F.struct(F.xxhash64("leaf", "line_key", F.lit("verbatim")).alias("template"), F.lit(1).alias("least"))),
    )
    templates = templates.select("leaf", "line_key", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("way"))
    templates = templates.select("leaf", "line_key", "way.template", "way.least")
    used = store(
        found.select("doc_id", "content", "place", "leaf", "line_key").join(templates, ["leaf", "line_key"])
        .select("doc_id", "content", "place", "template", "least"), "template-lines",
    )
    each = used.groupBy("template", "least", "content").agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "content")).alias("first")
    recurring = each.groupBy("template", "least").agg(F.count("*").alias("texts"), first).where(F.col("texts") >= F.col("least"))
    return used.join(recurring.select("template", F.col("first.content").alias("keeper")), "template").where("content <> keeper").select(
        "doc_id", "content", "place"
    )


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, depth: int = 3, constant: float = 0.8,
    long_tokens: int = 50, words: int = 2,
) -> DataFrame:
    """All columns of `docs` in a struct `row`, its new `text`, n_lines and n_dropped."""
    drops = recurring_lines(docs.select("doc_id", "text"), min_docs, min_tokens, depth, constant, long_tokens, words)
    drops = drops.groupBy("doc_id", "content").agg(F.collect_set("place").alias("places"))
    drops = drops.select(F.col("doc_id").alias("d"), F.col("content").alias("c"), "places")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_or_empty().alias("t")).withColumn(
        "content", F.xxhash64("t")
    )
    joined = rows.join(drops, rows["row.doc_id"].eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left")
    lines = F.split("t", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("places", i))
    return joined.select(
        "row", F.when(F.col("places").isNull(), F.col("row.text")).otherwise(F.concat_ws("\n", kept)).alias("text"),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
