"""Corpus pipeline: toxicity, recurring lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last keep the columns of `docs`, whatever they are called; they read
doc_id and text only. Rows that share a doc_id are judged each by its own text. Null texts count as empty and stay null. An empty
table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from bazaarlens.llm.common import read_table, store
from bazaarlens.llm.queries import labelled_texts

REJECT = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below `REJECT`; learned from the labels of the rows given."""
    model = toxicity.learn_toxicity(labelled_texts(docs, read_table(spark, sf_dir, "labels")))
    return docs.where(toxicity.toxicity_score(spark, model)(F.col("text")) < REJECT)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without recurring lines; a row left without any text is dropped, one that had none before stays."""
    cleaned = line_dedup.drop_recurring_lines(docs)
    cleaned = cleaned.where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return cleaned.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*").select(*(f"`{c}`" for c in docs.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, stored, as (row, place): decisions are made for rows, since rows may share a doc_id or lack one."""
    return store(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("place")), "rows")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id (rows without one come last)."""
    rows = numbered(docs)
    found = near_dedup.near_duplicates(rows.selectExpr("place AS doc_id", "row.text AS text")).select(F.col("doc_id").alias("place"), "component_id")
    ids = rows.selectExpr("place", "row.doc_id AS id")
    first = found.join(ids, "place").groupBy("component_id").agg(F.min(F.struct(F.isnull("id").alias("no"), "id", "place")).alias("first"))
    return rows.join(first.select("first.place"), "place", "left_semi").select("row.*")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    rows = numbered(docs)
    leaks = decontaminate.contaminated(rows.selectExpr("place AS doc_id", "row.text AS text"), read_table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias("place")).distinct(), "place", "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 4096 tokens."""
    return packing.pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("decontamination", leak_stage),
    ("packing", packing_stage),
]

#: The learned toxicity score cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; stages before the last are stored in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
