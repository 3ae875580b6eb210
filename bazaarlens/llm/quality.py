"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` words (the last may be shorter; a text without words has one empty passage). Each passage
is described by shares of kinds of words, by hashed words, by how far its words repeat, and by the text's length and line breaks.
An encoder turns the description into a vector h; gated attention weighs the passages of a text by
softmax over passages of w . (tanh(V h) * sigmoid(U h)), and the weighted sum of the vectors gives the score by a logistic unit. Encoder, attention and unit
are learned together in numpy from document labels alone; no passage is labelled.

Learning reads a bounded sample: the `max_texts` distinct labelled texts with the smallest digests, each with the mean label of its
rows, and of each at most `max_passages` evenly spaced passages. Scoring encodes every passage of every text.

A null text is empty. Repeated rows are scored once each. Rows without id are scored but not learned from. Null labels are ignored;
several labels of one document count by their mean. Without labels of both kinds every score is the mean label (0.5 if there is none). An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import mix64, ship, slices, split_words, text_or_empty, unpack

PASSAGE, BUCKETS, HIDDEN, GATE = 64, 24, 24, 12
KINDS = 8  # of bytes: lower, upper, digit, sentence mark, other mark, beyond ASCII, control, vowel
FLAGS = 8
WORD_FEATURES = KINDS + FLAGS + BUCKETS
FEATURES = WORD_FEATURES + 7


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, 4, dtype=np.int64)
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = 0, 1, 2
    kinds[list(b".,;:!?'\"()-")] = 3
    kinds[128:], kinds[:32], kinds[list(b"aeiouyAEIOUY")] = 5, 6, 7
    return kinds


BYTE_KINDS = byte_kinds()


# ---- passages -----------------------------------------------------------------------------------------------------

def describe_words(words: pa.Array) -> np.ndarray:
    """One row of numbers per distinct word."""
    words = words.cast(pa.large_binary())
    out = np.zeros((len(words), WORD_FEATURES), dtype=np.float32)
    if not len(words):
        return out
    buffers, begin = words.buffers(), words.offset
    offsets = np.frombuffer(buffers[1], np.int64)[begin : begin + len(words) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    length = np.diff(offsets)
    owner = np.repeat(np.arange(len(words)), length)
    counts = np.bincount(owner * KINDS + BYTE_KINDS[data], minlength=len(words) * KINDS).reshape(-1, KINDS)
    out[:, :KINDS] = counts / length[:, None]
    first, last = BYTE_KINDS[data[offsets[:-1]]], BYTE_KINDS[data[offsets[1:] - 1]]
    flags = [length / 8, np.log1p(length), first == 1, last == 3, last == 4, counts[:, 4] > 0, length == 1, counts[:, 1] > 1]
    out[:, KINDS : KINDS + FLAGS] = np.stack(flags, axis=1)
    turned = mix64(np.arange(64, dtype=np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        place = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], length), 63)
        parts = mix64((data.astype(np.uint64) + np.uint64(1)) * turned[place])
        digest = mix64(np.add.reduceat(parts, offsets[:-1]))
    out[np.arange(len(words)), KINDS + FLAGS + (digest % np.uint64(BUCKETS)).astype(np.int64)] = 1
    return out


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages of all texts in a row, and each text's number of passages."""
    words, sizes = split_words(texts, lower=False)
    sizes = sizes.astype(np.int64)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    table = describe_words(coded.dictionary)
    per_text = np.maximum(1, -(-sizes // PASSAGE))
    text = np.repeat(np.arange(len(sizes)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = (np.cumsum(sizes) - sizes)[text] + number * PASSAGE
    length = np.clip(sizes[text] - number * PASSAGE, 0, PASSAGE)
    out = np.zeros((len(text), FEATURES), dtype=np.float32)
    for at in range(0, len(text), 512):
        some = slice(at, at + 512)
        n = length[some]
        place = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = codes[place]
        passage = np.repeat(np.arange(len(n)), n)
        filled = np.flatnonzero(n)
        if len(filled):
            starts = (np.cumsum(n) - n)[filled]
            out[at + filled, :WORD_FEATURES] = np.add.reduceat(table[own], starts, axis=0) / n[filled][:, None]
        many = np.maximum(n, 1)
        base = np.int64(len(table) + 1)

        def distinct(keys, of, n=n):
            return np.bincount(np.unique(of * base**2 + keys) // base**2, minlength=len(n))

        inside = passage[1:] == passage[:-1]
        same = np.bincount(passage[1:][inside & (own[1:] == own[:-1])], minlength=len(n))
        out[some, WORD_FEATURES] = distinct(own, passage) / many
        out[some, WORD_FEATURES + 1] = distinct((own[:-1] * base + own[1:])[inside], passage[1:][inside]) / many
        out[some, WORD_FEATURES + 2] = same / many
    lines = pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False)
    bytes_of = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out[:, WORD_FEATURES + 3] = length / PASSAGE
    out[:, WORD_FEATURES + 4] = np.log1p(sizes)[text]
    out[:, WORD_FEATURES + 5] = (lines / np.maximum(sizes, 1))[text]
    out[:, WORD_FEATURES + 6] = (bytes_of / np.maximum(sizes, 1) / 8)[text]
    return out, per_text


# ---- the network --------------------------------------------------------------------------------------------------

def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Scaling of descriptions, weights by name, and the mean label."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    prior: float

    def forward(self, x: np.ndarray, sizes: np.ndarray):
        """Scores, attention weights and what the backward pass needs; x holds all passages, `sizes` the passages of each text."""
        w = self.weights
        starts = np.cumsum(sizes) - sizes
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["e"] + w["eb"])
        t, s = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
        raw = (t * s) @ w["a"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        attention = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return sigmoid(z @ w["c"] + w["cb"]), attention, (x, h, t, s, z, starts)

    def gradients(self, x, sizes, goal):
        score, attention, (x, h, t, s, z, _) = self.forward(x, sizes)
        w = self.weights
        d = (score - goal) / len(goal)
        g = {"c": z.T @ d, "cb": d.sum(keepdims=True)}
        dz = np.repeat(d[:, None] * w["c"], sizes, axis=0)
        # through the softmax of each bag
        pull = (dz * h).sum(axis=1)
        mean = np.repeat(np.add.reduceat(attention * pull, np.cumsum(sizes) - sizes), sizes)
        draw = attention * (pull - mean)
        g["a"] = (t * s).T @ draw
        dt, ds = draw[:, None] * w["a"] * s * (1 - t * t), draw[:, None] * w["a"] * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh = (attention[:, None] * dz + dt @ w["v"].T + ds @ w["u"].T) * (1 - h * h)
        g["e"], g["eb"] = x.T @ dh, dh.sum(axis=0)
        return g

    def score(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.weights is None:
            return np.full(len(sizes), self.prior), np.repeat(1 / sizes, sizes)
        return self.forward(x, sizes)[:2]


def learn_attention(x: np.ndarray, sizes: np.ndarray, goal: np.ndarray, epochs: int = 40, seed: int = 11) -> AttentionModel:
    """Adam over shuffled batches of texts; the weights are the mean of those after each epoch of the second half."""
    prior = float(goal.mean()) if len(goal) else 0.5
    if not len(goal) or goal.min() == goal.max():
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), None, prior)
    rng = np.random.default_rng(seed)
    shapes = {"e": (FEATURES, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "cb": (1,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(shape[0]), shape) if len(shape) > 1 or k in "ac" else np.zeros(shape) for k, shape in shapes.items()}
    model = AttentionModel(x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3, weights, prior)
    model.weights["cb"][:] = np.log((prior + 1e-6) / (1 - prior + 1e-6))
    first, second = ({k: np.zeros(shape) for k, shape in shapes.items()} for _ in range(2))
    average, kept, step = {k: np.zeros(shape) for k, shape in shapes.items()}, 0, 0
    starts = np.cumsum(sizes) - sizes
    for epoch in range(epochs):
        order = rng.permutation(len(sizes))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            n = sizes[chosen]
            rows = np.repeat(starts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            step += 1
            for k, g in model.gradients(x[rows], n, goal[chosen]).items():
                g = g + (1e-4 * weights[k] if weights[k].ndim > 1 else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.01 / (1 + epoch / 8) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
        if epoch >= epochs // 2:
            kept += 1
            for k in shapes:
                average[k] += weights[k]
    model.weights = {k: v / kept for k, v in average.items()}
    return model


# ---- the operator -------------------------------------------------------------------------------------------------

def learn_quality(docs: DataFrame, labels: DataFrame, max_texts: int = 8000, max_passages: int = 64) -> AttentionModel:
    """The model of docs (doc_id, text) under labels (doc_id, label 0 or 1)."""

    def describe(batches):
        for part in slices(batches, 500):
            x, sizes = passages(part.column("content"))
            starts = np.cumsum(sizes) - sizes
            kept = np.minimum(sizes, max_passages)
            step = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
            rows = np.repeat(starts, kept) + step * np.repeat(sizes, kept) // np.repeat(kept, kept)
            ends = np.concatenate(([0], np.cumsum(kept)))
            raw = [x[rows[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), part.column("goal"), pa.array(kept, pa.int64()), pa.array(raw, pa.binary())], ["digest", "goal", "n", "x"]
            )

    digest = F.sha2(text_or_empty().cast("binary"), 256)
    marks = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    narrow = docs.select("doc_id", digest.alias("digest")).join(marks, "doc_id")
    # distinct texts only travel as digests; the bound holds for copies too
    chosen = narrow.groupBy("digest").agg(F.avg("label").alias("goal")).orderBy("digest").limit(max_texts)
    wanted = docs.select(digest.alias("digest"), text_or_empty().alias("content")).join(F.broadcast(chosen), "digest")
    found = wanted.dropDuplicates(["digest"]).mapInArrow(describe, "digest string, goal double, n long, x binary").toArrow().sort_by("digest")
    sizes = found.column("n").to_numpy().astype(np.int64)
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    return learn_attention(x, sizes, found.column("goal").to_numpy())


def score_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, score, n_passages, top_passage (the one with most attention, from 0), top_weight per row of docs (doc_id, text)."""
    shared = ship(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        m = unpack(shared)
        for part in slices(batches, 4000):
            x, sizes = passages(part.column("content"))
            score, attention = m.score(x, sizes)
            starts = np.cumsum(sizes) - sizes
            most = np.maximum.reduceat(attention, starts)
            hit = np.flatnonzero(attention == np.repeat(most, sizes))
            top = hit[np.searchsorted(hit, starts)] - starts
            columns = [part.column("doc_id"), *map(pa.array, (score.astype(float), sizes, top, most.astype(float)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    rows = docs.select("doc_id", text_or_empty().alias("content"))
    return rows.mapInArrow(work, f"doc_id {kind}, score double, n_passages long, top_passage long, top_weight double")
