"""Registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import ann, chat, decontaminate, langid, line_dedup, lm, near_dedup, packing, quality, runs, token_counts, toxicity, whitening
from bazaarlens.llm.common import fold, read_table


def held_out(modulus: int, remainder: int):
    return F.coalesce(fold(F.col("doc_id"), modulus) == remainder, F.lit(False))


def op1_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"), held_out(7, 2))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.learn_languages(docs.where(fold(F.col("doc_id"), 5) != 0).select("text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "accepted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample of the texts that may be learned from, with their labels. Only hashes of texts meet the labels."""
    labels = labels.where(fold(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashes = docs.select("doc_id", toxicity.text_hash().alias("pick")).join(labels, "doc_id")
    return toxicity.sample_texts(hashes.select("pick", F.col("toxic").cast("int").alias("toxic")), docs)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn_toxicity(labelled_texts(docs, read_table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", toxicity.toxicity_score(spark, model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_planted_periods(read_table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learned = labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    found = quality.score_quality(docs, quality.learn_quality(docs, learned))
    return found.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight"
    )


QUERIES = {
    "op1_likelihood": op1_likelihood,
    "op2_language": op2_language,
    "op3_chat": op3_chat,
    "op4_tokens": op4_tokens,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_lines": op7_lines,
    "op8_leaks": op8_leaks,
    "op9_near": op9_near,
    "op10_neighbours": op10_neighbours,
    "op11_runs": op11_runs,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}

ORACLE: dict[str, str] = {
    "op7_lines": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM d),
        k AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
        m AS (SELECT *, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS g FROM k WHERE len(w) >= 3),
        f AS (SELECT doc_id, t, place, line, g, len(g) AS n, g[1:3] AS lead FROM m),
        p AS (SELECT n, lead, line, any_value(g) AS g, count(DISTINCT t) AS texts FROM f GROUP BY n, lead, line),
        e AS (SELECT n, lead, line, texts, unnest(g) AS token, generate_subscripts(g, 1) AS pos FROM p),
        s AS (SELECT *, sum(texts) OVER (PARTITION BY n, lead, pos, token) AS support FROM e),
        c AS (SELECT n, lead, line, texts, list(CASE WHEN support >= 3 THEN token ELSE '<*>' END ORDER BY pos) AS template,
                     coalesce(avg(CASE WHEN support >= 3 THEN 1.0 ELSE 0.0 END) FILTER (token <> '<*>'), 0.0) >= 0.8
                       AND count(*) FILTER (support >= 3 AND token <> '<*>') >= 2 AS general
              FROM s GROUP BY n, lead, line, texts),
        y AS (SELECT n, lead, line, 'template' AS way, template, 3 AS least FROM c WHERE general
              UNION ALL
              SELECT n, lead, line, 'verbatim', [line], 1 FROM c
              WHERE texts >= CASE WHEN n >= 50 THEN 2 ELSE 3 END AND NOT (general AND texts >= 3)),
        u AS (SELECT f.doc_id, f.t, f.place, y.n, y.lead, y.way, y.template, y.least FROM f JOIN y USING (n, lead, line)),
        r AS (SELECT n, lead, way, template, arg_min(t, doc_id) AS keeper FROM u
              GROUP BY n, lead, way, template, least HAVING count(DISTINCT t) >= least),
        x AS (SELECT DISTINCT u.doc_id, u.t, u.place FROM u JOIN r USING (n, lead, way, template) WHERE u.t <> r.keeper)
        SELECT l.doc_id, count(*) AS n_lines, count(x.place) AS n_dropped,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (x.place IS NULL), '')) AS text_sha256
        FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.t = x.t AND l.place = x.place
        GROUP BY l.doc_id, l.t
    """,
    "op8_leaks": """
        WITH b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        i AS (SELECT item_id, least(len(w), 5) AS k, unnest(list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2),
                  lambda j: array_to_string(w[j : j + least(len(w), 5) - 1], ' ')))) AS shingle FROM b WHERE len(w) > 0),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        k AS (SELECT DISTINCT k FROM i),
        s AS (SELECT doc_id, k.k, unnest(list_transform(range(1, len(w) - k.k + 2),
                  lambda j: array_to_string(w[j : j + k.k - 1], ' '))) AS shingle FROM d JOIN k ON len(w) >= k.k),
        z AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
        h AS (SELECT s.doc_id, i.item_id, count(DISTINCT s.shingle) AS shared FROM s JOIN i ON s.k = i.k AND s.shingle = i.shingle GROUP BY ALL)
        SELECT h.doc_id, h.item_id, h.shared, z.item_shingles, h.shared / z.item_shingles AS containment
        FROM h JOIN z USING (item_id) WHERE h.shared * 100 >= z.item_shingles * 80
    """,
}
