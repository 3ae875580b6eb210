"""Language identification: averaged hashed subword embeddings with a linear softmax, and a calibrated rejection rule.

Subwords are the runs of 2 to 4 bytes of lower-cased words, where any byte that is no letter marks a word's edge and may
only be the first or last of a run. Each is hashed to a bucket; a text is the mean of its buckets' embeddings. Since the
classifier is linear, prediction sums one row of logits per subword, over the whole text.

The model is fitted by stochastic gradient descent in numpy on the driver, on at most `rows_per_language` distinct labelled
texts of each language (those of the smallest hashes) and some of their lines, so that short texts are known too. A quarter of
them, never a language's first, is kept apart for the temperature of the scores and for the score below which a language is not accepted.

A text that is null or has no letter is `und` with score 0. Rows are independent, so repeated rows get equal results.
Without any labelled row every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm.common import ship, slices, store, text_or_empty, unpack

UNKNOWN = "und"
ORDERS = (2, 3, 4)
#: ASCII bytes that are no letters are edges; bytes of longer UTF-8 sequences count as letters.
EDGES = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class LanguageModel:
    """`table` holds each bucket's contribution to the logits, embedding times output weights; with more languages than
    dimensions it holds the embeddings, and `out` the weights."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float
    out: np.ndarray | None = None

    @property
    def buckets(self) -> int:
        return len(self.table)


def subwords(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all valid subwords of all texts, in text order by length of run; for each run length, bounds by text.

    Returns (ids, bounds, lengths) where ids[bounds[k, i] : bounds[k, i + 1]] are the buckets of text i for ORDERS[k].
    """
    raw = [b" " + t.lower().encode("utf-8", "ignore").translate(EDGES) + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    letter = data != 32
    ids, bounds, at = [], np.zeros((len(ORDERS), len(texts) + 1), dtype=np.int64), 0
    key = data.astype(np.uint32)
    for k, order in enumerate(ORDERS):
        span = len(data) - order + 1
        if span <= 0:
            bounds[k] = at
            continue
        valid = letter[:span] | letter[order - 1 :]
        for inner in range(1, order - 1):
            valid &= letter[inner : inner + span]
        key_k = key[:span].copy()
        for step in range(1, order):
            key_k = (key_k << np.uint32(8)) | key[step : step + span]
        chosen = np.flatnonzero(valid)
        with np.errstate(over="ignore"):
            hashed = (key_k[chosen] + np.uint32(order)) * np.uint32(2654435761)
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(2246822519)
        ids.append((hashed >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32))
        # a run of two edges is not valid, so no run spans two texts
        bounds[k] = at + np.searchsorted(chosen, starts)
        at += len(chosen)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), bounds, starts


def text_logits(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of table rows and number of subwords, per text."""
    ids, bounds, _ = subwords(texts, len(table))
    total = np.zeros((len(texts), table.shape[1]))
    for k in range(len(ORDERS)):
        for column in range(table.shape[1]):
            running = np.concatenate(([0.0], np.cumsum(table[ids[bounds[k, 0] : bounds[k, -1]], column], dtype=np.float64)))
            edge = bounds[k] - bounds[k, 0]
            total[:, column] += running[edge[1:]] - running[edge[:-1]]
    return total, (bounds[:, 1:] - bounds[:, :-1]).sum(axis=0)


def softmax(logits: np.ndarray) -> np.ndarray:
    z = np.exp(logits - logits.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_language_model(
    examples: list[tuple[str, np.ndarray, np.ndarray, bool]], buckets: int = 1 << 16, width: int = 12,
    epochs: int = 6, rate: float = 0.5, precision: float = 0.99, seed: int = 7,
) -> LanguageModel:
    """Fit on (language, bucket ids, their counts, kept apart for calibration)."""
    labels = sorted({e[0] for e in examples})
    if not labels:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (buckets, width)).astype(np.float32)
    out, bias = np.zeros((width, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    code = {label: i for i, label in enumerate(labels)}
    train = [e for e in examples if not e[3]] or examples
    held = [e for e in examples if e[3]] or examples
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            label, ids, counts, _ = train[i]
            share = (counts / counts.sum()).astype(np.float32)
            vector = share @ embed[ids]
            error = softmax((vector @ out + bias)[None])[0]
            error[code[label]] -= 1
            now = np.float32(rate * (1 - step / steps))
            back = out @ error
            out -= now * np.outer(vector, error)
            bias -= now * 0.1 * error
            # a row moves by its share of the text; the factor keeps rare subwords from standing still
            embed[ids] -= (now * 20) * share[:, None] * back[None]
            step += 1
    wide = len(labels) > width
    table = embed if wide else (embed @ out).astype(np.float32)
    logits = np.array([(c / c.sum()) @ table[ids] for _, ids, c, _ in held])
    logits = (logits @ out if wide else logits) + bias
    truth = np.array([code[e[0]] for e in held])

    def loss(temperature):
        p = softmax(logits / temperature)[np.arange(len(truth)), truth]
        return -np.log(np.maximum(p, 1e-12)).mean()

    temperature = min(np.geomspace(0.005, 10, 120), key=loss)
    chance = softmax(logits / temperature)
    score, right = chance.max(axis=1), chance.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    least = float(score[order[np.flatnonzero(precise)[-1]]]) if precise.any() else 1.0
    return LanguageModel(labels, table, bias.astype(np.float64), float(temperature), least, out if wide else None)


def training_examples(batches, buckets: int):
    """mapInArrow function: (lang, content, apart) to bucket counts of the text and of up to three of its lines."""
    for part in slices(batches, 500):
        rows = {"lang": [], "ids": [], "counts": [], "apart": []}
        for lang, text, apart in zip(*(part.column(c).to_pylist() for c in ("lang", "content", "apart")), strict=True):
            lines = text.split("\n")
            for piece in [text, *(lines[:: max(1, len(lines) // 3)][:3] if len(lines) > 1 else [])]:
                ids, _, _ = subwords([piece], buckets)
                if len(ids):
                    unique, counts = np.unique(ids, return_counts=True)
                    for key, value in zip(rows, (lang, unique.tolist(), counts.tolist(), apart), strict=True):
                        rows[key].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["lang"], pa.string()), pa.array(rows["ids"], pa.list_(pa.int32())),
             pa.array(rows["counts"], pa.list_(pa.int32())), pa.array(rows["apart"], pa.bool_())], list(rows),
        )


def learn_languages(
    labelled: DataFrame, rows_per_language: int = 700, max_texts: int = 140_000, buckets: int = 1 << 16, **fit
) -> LanguageModel:
    """Fit on at most `rows_per_language` distinct texts of each language, fewer if all would be more than `max_texts` (bounded
    sample; every language keeps at least one)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", text_or_empty().alias("content"), F.xxhash64("text").alias("pick")
    )
    texts = store(rows.select("lang", "pick").distinct(), "lang-texts")
    languages = texts.select("lang").distinct().count()
    each = max(1, min(rows_per_language, max_texts // max(languages, 1)))
    # the smallest hashes of each part of a language first, so that no task meets all of a frequent one
    part = F.pmod(F.xxhash64(F.lit(2), "pick"), F.lit(64))
    cut = texts.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy("pick"))).where(F.col("place") <= each)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("pick")).alias("place")
    picked = cut.select("lang", "pick", first).where(F.col("place") <= each)
    # copies of a text meet inside each partition first
    chosen = rows.join(F.broadcast(picked), ["lang", "pick"]).groupBy("lang", "pick", "place").agg(F.first("content").alias("content")).select(
        "lang", "content", ((F.col("place") > 1) & (F.pmod(F.xxhash64(F.lit(1), "pick"), F.lit(4)) == 0)).alias("apart")
    )
    made = chosen.mapInArrow(lambda b: training_examples(b, buckets), "lang string, ids array<int>, counts array<int>, apart boolean")
    examples = [
        (lang, ids.values.to_numpy(), counts.values.to_numpy().astype(np.float64), apart.as_py())
        for batch in made.toArrow().to_batches()
        for lang, ids, counts, apart in zip(batch[0].to_pylist(), batch[1], batch[2], batch[3], strict=True)
    ]
    examples.sort(key=lambda e: (e[0], len(e[1]), float(e[2].sum()), int(e[1].sum())))
    return fit_language_model(examples, buckets=buckets, **fit)


def predict_rows(batches, model: LanguageModel):
    """mapInArrow body: (key, content) to key, lang_pred, score, accepted."""
    import regex

    letter = regex.compile(r"\p{L}")
    for part in slices(batches, 500):
        texts = part.column("content").to_pylist()
        known = np.array([letter.search(t) is not None for t in texts])
        if model.labels:
            total, n = text_logits(texts, model.table)
            mean = total / np.maximum(n, 1)[:, None]
            chance = softmax(((mean if model.out is None else mean @ model.out) + model.bias) / model.temperature)
            best, score = chance.argmax(axis=1), chance.max(axis=1)
            names = [model.labels[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            score = np.where(known, score, 0.0)
        else:
            names, score, known = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(known & (score >= model.least_score))],
            ["key", "lang_pred", "score", "accepted"],
        )


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score, accepted for every row; `accepted` is the calibrated rejection rule."""
    shared = ship(docs.sparkSession, model)
    rows = docs.select(F.col(key).alias("key"), text_or_empty().alias("content"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(
        lambda batches: predict_rows(batches, unpack(shared)), f"key {kind}, lang_pred string, score double, accepted boolean"
    )
    return found.withColumnRenamed("key", key)
