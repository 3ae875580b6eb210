"""Shared helpers: tables, stored intermediate results, document folds, word splitting in Arrow."""

from __future__ import annotations

import os
import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.session import ensure_checkpoint_dir

MASK64 = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder, which the driver and all executors reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def ship(spark: SparkSession, model) -> Broadcast:
    """Broadcast of a fitted model together with its class, so executors need no install. Models are of bounded size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def unpack(shared: Broadcast):
    return pickle.loads(shared.value)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key falls in no fold and gives null."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in a row (A-Z lower-cased if asked), and each text's number of words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # a copy whose offsets begin at 0: lower-casing a slice gives wrong offsets in some Arrow versions
    texts = pa.concat_arrays([texts, texts.slice(0, 0)])
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0)
    mask = filled.to_numpy(zero_copy_only=False)
    offsets = np.asarray(parts.offsets) - parts.offsets[0].as_py()
    before = np.concatenate(([0], np.cumsum(mask)))
    return words.filter(filled), before[offsets[1:]] - before[offsets[:-1]]


def mix64(values: np.ndarray) -> np.ndarray:
    """A fixed bijective mix of unsigned 64-bit numbers (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slices(batches, rows: int, size: int = 4_000_000):
    """Arrow record batches cut to at most `rows` rows and about `size` bytes of text, so that memory depends on no batch setting.

    A row longer than `size` is a slice of its own. After the last one Arrow's unused memory is given back.
    """
    try:
        for batch in batches:
            length = np.zeros(batch.num_rows, dtype=np.int64)
            for column in batch.columns:
                if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                    length += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(length), 0
            while start < batch.num_rows:
                fits = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
                stop = min(start + rows, max(fits, start + 1))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        give_back()


def give_back():
    """Returns Arrow's unused memory to the system: workers wait for later tasks, side by side with those of other stages."""
    pa.default_memory_pool().release_unused()


class Memory:
    """What a task remembers by key, in two generations of about `limit` bytes: keys met again move to the young one."""

    def __init__(self, limit: int = 48_000_000):
        self.young: dict = {}
        self.old: dict = {}
        self.size, self.limit = 0, limit

    def put(self, keys, values):
        self.young.update(zip(keys, values, strict=True))
        self.size += 160 * len(keys) + 2 * sum(map(len, keys))

    def missing(self, keys: set) -> set:
        """The keys not remembered; all others can be read in `young` until the next call."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        absent = keys.difference(self.young)
        # an intersection with a dictionary would walk all of it
        new = absent.difference(self.old)
        kept = list(absent.difference(new))
        self.put(kept, [self.old[key] for key in kept])
        return new


def load_tokenizer(path: str):
    """The tokenizer of a vocabulary file, whole texts, one thread: Spark's tasks are the parallelism, and the library's own
    threads each keep an allocator of their own, which grows from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
