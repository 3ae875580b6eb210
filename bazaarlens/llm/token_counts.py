"""Token counts through a digest cache.

Content (null text: empty) is keyed by its SHA-256; stored counts are joined on that digest and the digest of the tokenizer
version. Only distinct contents without a stored count are encoded, and their counts are appended to the cache, a Parquet
folder that may be shared by many runs (a digest appended twice holds the same count twice).

Null or repeated rows each keep their row; an empty text has no tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import Memory, load_tokenizer, shared_folder, slices, text_or_empty

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
WHOLE = -(1 << 50)  # mark of a chunk that cannot be counted alone


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library's version."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def make_counter(path: str):
    """A function from a list of texts to token counts, equal to the library's on whole texts.

    A byte-level pre-tokenizer starts a new piece at any single blank or line feed between printable characters, so the
    chunks between them are encoded alone and remembered in bounded memory. A text with any other white space or unprintable
    character next to a cut is encoded whole.
    """
    tokenizer = load_tokenizer(path)
    known = Memory()

    def encode(texts):
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(keys):
        clean, other = [], []
        for key in keys:
            body = key[1:] if key[:1] in ("\n", "\0") else key
            (clean if body and " " not in body and body.isprintable() else other).append(key)
        known.put(other, [WHOLE] * len(other))
        pieces = [k[1:] if k[0] == "\0" else k if k[0] == "\n" else " " + k for k in clean]
        for start in range(0, len(clean), 20_000):
            known.put(clean[start : start + 20_000], encode(pieces[start : start + 20_000]))

    def count(texts):
        cut = []
        for text in texts:
            if "\0" in text:  # a later chunk that begins with the mark of first ones
                cut.append(["\0 "])
                continue
            chunks = text.replace("\n", " \n").split(" ")
            chunks[0] = "\0" + chunks[0]
            cut.append(chunks)
        learn(known.missing(set(chain.from_iterable(cut))))
        counts = [sum(map(known.young.__getitem__, chunks)) for chunks in cut]
        whole = [i for i, n in enumerate(counts) if n < 0 and texts[i]]
        for i, n in zip(whole, encode([texts[i] for i in whole]), strict=True):
            counts[i] = n
        return [n if text else 0 for n, text in zip(counts, texts, strict=True)]

    return count


def encode_counts(path: str, version: str):
    """mapInArrow function: (digest, content) to cache rows."""

    def encode(batches):
        count = make_counter(path)
        for part in slices(batches, 500):
            counts = count(part.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), pa.array([version] * part.num_rows, pa.string()), pa.array(counts, pa.int64())],
                ["digest", "version", "n_tokens"],
            )

    return encode


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of `docs` (doc_id, text); counts missing in `cache` are appended to it.

    Without `cache` a new one is made in the shared folder. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    cache = cache or shared_folder(spark, "token-cache")
    version = tokenizer_version(tokenizer)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def cached() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    contents = docs.select("doc_id", text_or_empty().alias("content"))
    contents = contents.withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    # equal contents meet inside each partition first, so a content held by a third of all rows travels once per partition
    distinct = contents.groupBy("digest").agg(F.first("content").alias("content"))
    missing = distinct.join(cached().select("digest"), "digest", "left_anti")
    missing.mapInArrow(encode_counts(tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(cache)

    sized = contents.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "digest")
    return sized.join(cached(), "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
