"""Document log-likelihood under a gated recurrent language model, beside an add-one unigram baseline.

Tokens are words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) and one end per text. Word counts cover all training texts. The
`SHORT` most frequent words (the end is one) are symbols of their own; every other word, known or not, belongs to one of
`TAILS` tail classes by its character n-grams (spherical k-means, fitted on frequent words). The output softmax is
class-factored: a class from the hidden state, then a word within the class from the hidden state for frequent words, and by
smoothed counts for a tail class, (count + 1) / (class tokens + class words + 1), where all unknown words of a class share the
last place. These are proper distributions.

The model is a gated recurrent unit, trained by truncated backpropagation in numpy: lanes of text, windows of `STEPS` tokens,
the state carried from window to window and cleared at a text's start. It learns from every training row once, copies of a
text included: the rows are dealt to rounds by a hash of id and text, each task of a round trains a copy of the network on its
part, and the copies are averaged before the next round. Scoring runs over whole texts, many side by side, and carries the
state through all windows.

Counts of the `known_words` most frequent words travel with the tasks (bounded); rarer words of a text are joined to the
stored counts. A null text is empty and scores its end. Repeated rows are scored and counted once each. Without training
texts every word is unknown. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import give_back, ship, slices, split_words, store, text_or_empty, unpack

CLASS_SIZE, SHORT, TAILS, HIDDEN, STEPS = 64, 4096, 16, 24, 16
HEADS = SHORT // CLASS_SIZE
SYMBOLS, CLASSES, GRAM_BUCKETS = SHORT + TAILS, HEADS + TAILS, 1024
SHAPES = {
    "x": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
    "wi": (HEADS, HIDDEN, CLASS_SIZE), "bi": (HEADS, CLASS_SIZE),
}
LOG10 = math.log(10.0)
# bytes, which numpy sorts by counting
CLASS_OF = np.concatenate((np.repeat(np.arange(HEADS), CLASS_SIZE), HEADS + np.arange(TAILS))).astype(np.uint8)


# ---- words --------------------------------------------------------------------------------------------------------

def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- and 3-byte runs of each word with a mark on both ends, and where each word's runs begin."""
    kind = pa.large_binary()
    marked = pc.binary_join_element_wise(pa.scalar(b"\x01", kind), words.cast(kind), pa.scalar(b"\x02", kind), pa.scalar(b"", kind))
    bounds = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.uint32)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    two = data.copy()
    two[:-1] = (data[:-1] << np.uint32(8)) | data[1:]
    three = two.copy()
    three[:-1] = (two[:-1] << np.uint32(8)) | np.concatenate((data[2:], data[:1]))
    with np.errstate(over="ignore"):
        keys = np.stack([two * np.uint32(2654435761), (three + np.uint32(7)) * np.uint32(2246822519)])
    return (keys >> np.uint32(32 - GRAM_BUCKETS.bit_length() + 1)).astype(np.int64), starts


def tail_class(words: pa.Array, table: np.ndarray) -> np.ndarray:
    """The nearest centre of each word."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    out = []
    # 64 bytes for each run of each word
    for start in range(0, len(words), 8192):
        keys, starts = grams(words.slice(start, 8192))
        out.append(np.add.reduceat(table[keys[0]] + table[keys[1]], starts, axis=0).argmax(axis=1))
    return np.concatenate(out)


def fit_tails(words: pa.Array, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Centres (buckets, classes) of spherical k-means over the words' n-gram counts."""
    rng = np.random.default_rng(seed)
    if not len(words):
        return rng.normal(size=(GRAM_BUCKETS, TAILS)).astype(np.float32)
    keys, starts = grams(words)
    counts = np.zeros((len(words), GRAM_BUCKETS), dtype=np.float32)
    owner = np.repeat(np.arange(len(words)), np.diff(np.concatenate((starts, [keys.shape[1]]))))
    for row in keys:
        np.add.at(counts, (owner, row), 1)
    # common runs say little
    counts *= np.log((1 + len(words)) / (1 + (counts > 0).sum(axis=0)))
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    centres = counts[rng.choice(len(words), TAILS, replace=len(words) < TAILS)]
    for _ in range(rounds):
        own = (counts @ centres.T).argmax(axis=1)
        for k in range(TAILS):
            members = counts[own == k]
            if len(members):
                centre = members.sum(axis=0)
                centres[k] = centre / max(np.linalg.norm(centre), 1e-9)
    weight = np.log((1 + len(words)) / (1 + (counts > 0).sum(axis=0)))
    return (centres * weight).T.astype(np.float32)


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


@dataclass
class Vocabulary:
    """Frequent words with counts (most frequent first), the tail classes, and totals over all training tokens."""

    words: pa.Array
    counts: np.ndarray
    classes: np.ndarray
    table: np.ndarray
    texts: int
    tokens: int
    distinct: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    # each frequent word's place, made by the task that looks words up: Arrow's own lookup would hash all of them for each slice
    places: dict[bytes, int] = field(default_factory=dict, repr=False)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct word: its symbol, its count among frequent words (0: none), whether it is a frequent word."""
        if len(self.places) < len(self.words):
            self.places = {word: i for i, word in enumerate(as_bytes(self.words))}
        place = np.fromiter(map(self.places.get, as_bytes(words), repeat(-1)), np.int64, len(words))
        listed = place >= 0
        place = np.maximum(place, 0)
        symbols = np.where(place < SHORT - 1, place + 1, 0) if len(self.words) else np.zeros(len(words), np.int64)
        tail = listed & (place >= SHORT - 1)
        symbols[tail] = SHORT + self.classes[place[tail]]
        symbols[~listed] = SHORT + tail_class(words.filter(pa.array(~listed)), self.table)
        counts = np.where(listed, self.counts[place] if len(self.counts) else 0, 0)
        return symbols, counts, listed


def count_words(texts: DataFrame) -> DataFrame:
    """word, c over all rows of (content)."""

    def merged(parts):
        table = pa.table({"word": pa.concat_arrays([p.field(0) for p in parts]), "c": pa.concat_arrays([p.field(1) for p in parts])})
        return table.group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def work(batches):
        parts, rows = [], 0
        for part in slices(batches, 2000):
            found = split_words(part.column("content"))[0].value_counts()
            parts.append(found)
            rows += len(found)
            if rows > 600_000:
                yield from merged(parts).to_batches()
                parts, rows = [], 0
        if parts:
            yield from merged(parts).to_batches()

    return texts.mapInArrow(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_vocabulary(texts: DataFrame, known_words: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of (content) rows, and the stored counts of all words."""
    counts = store(count_words(texts), "word-counts")
    n_texts = texts.count()
    total = counts.agg(F.sum("c"), F.count("*")).first()
    steps = counts.groupBy("c").count().orderBy(F.desc("c")).limit(known_words + 1).toArrow()
    size = np.cumsum(steps.column("count").to_numpy()) if steps.num_rows else np.zeros(0)
    fits = np.flatnonzero(size <= known_words)
    least = int(steps.column("c")[int(fits[-1])].as_py()) if len(fits) else 1 << 62
    top = counts.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words = top.column("word").combine_chunks().cast(pa.large_string())
    words = words if isinstance(words, pa.Array) else pa.concat_arrays(words.chunks or [pa.array([], pa.large_string())])
    table = fit_tails(words.slice(0, 8192))
    number = top.column("c").to_numpy()
    short = words.slice(0, SHORT - 1).cast(pa.string())

    def tails(batches):
        tokens, distinct = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for part in slices(batches, 50_000):
            rest = pc.invert(pc.is_in(part.column("word").cast(pa.string()), value_set=short))
            own = tail_class(part.column("word").filter(rest), table)
            c = part.column("c").filter(rest).to_numpy()
            tokens += np.bincount(own, c, TAILS).astype(np.int64)
            distinct += np.bincount(own, minlength=TAILS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS)), pa.array(tokens), pa.array(distinct)], ["k", "tokens", "words"])

    sums = counts.mapInArrow(tails, "k long, tokens long, words long").groupBy("k").agg(F.sum("tokens"), F.sum("words")).collect()
    tail_tokens, tail_words = np.zeros(TAILS), np.zeros(TAILS)
    for k, tokens, distinct in sums:
        tail_tokens[k], tail_words[k] = tokens, distinct
    return Vocabulary(
        words, number, tail_class(words, table), table, n_texts, int(total[0] or 0) + n_texts, int(total[1]) + (n_texts > 0),
        tail_tokens, tail_words,
    ), counts.where(F.col("c") < least)


# ---- the network --------------------------------------------------------------------------------------------------

def new_weights(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; output biases at the logs of the symbols' shares."""
    rng = np.random.default_rng(seed)
    weights = {k: rng.normal(0, 0.08, shape).astype(np.float32) for k, shape in SHAPES.items()}
    share = np.full(SHORT, 0.5)
    share[0] += vocabulary.texts
    share[1 : 1 + min(len(vocabulary.counts), SHORT - 1)] += vocabulary.counts[: SHORT - 1]
    heads = share.reshape(HEADS, CLASS_SIZE)
    weights["bi"] = np.log(heads / heads.sum(axis=1, keepdims=True)).astype(np.float32)
    groups = np.concatenate((heads.sum(axis=1), vocabulary.tail_tokens + 1))
    weights["bc"] = np.log(groups / groups.sum()).astype(np.float32)
    weights["b"][:] = 0
    weights["b"][:HIDDEN] = 1.0
    return weights


def advance(u, x, h):
    """One step of the unit for lanes side by side, one per column: new state, and what backpropagation needs.

    `u` is transposed; `x` holds what the symbols add, and is overwritten.
    """
    a = u @ h
    gates, n, an = x[: 2 * HIDDEN], x[2 * HIDDEN :], a[2 * HIDDEN :]
    gates += a[: 2 * HIDDEN]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:HIDDEN], gates[HIDDEN:]
    n += r * an
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, (z, r, n, an)


def step(w, symbols, h):
    """One step of the unit, one lane per row."""
    out, kept = advance(w["u"].T, (w["x"].take(symbols, axis=0) + w["b"]).T, h.T)
    return out.T, kept


def class_of(targets: np.ndarray) -> np.ndarray:
    return CLASS_OF[targets]


def outputs(w):
    """Output weights with the biases as a last row, and whether their exponentials need no shift.

    States lie between -1 and 1, so no logit exceeds the sum of its weights.
    """
    wc, wi = np.concatenate((w["wc"], w["bc"][None])), np.concatenate((w["wi"], w["bi"][:, None]), axis=1)
    return wc, wi, max(float(np.abs(wc).sum(axis=0).max()), float(np.abs(wi).sum(axis=1).max())) < 80


def with_one(states: np.ndarray) -> np.ndarray:
    return np.concatenate((states, np.ones((1, states.shape[1]), states.dtype)))


def by_head(targets: np.ndarray):
    """Class of each target, the places of those in heads in order of their head, and each head's bounds there."""
    group = class_of(targets)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=HEADS)[:HEADS])))
    order = np.argsort(group, kind="stable")[: bounds[-1]]
    return group, order, [(head, bounds[head], bounds[head + 1]) for head in np.flatnonzero(np.diff(bounds)).tolist()]


def within_heads(wi, own, heads, near) -> np.ndarray:
    """Logits within the classes: one column for each state of `own`, which are in order of their heads."""
    inner = np.empty((CLASS_SIZE, own.shape[1]), own.dtype)
    for head, begin, end in heads:
        np.matmul(wi[head].T, own[:, begin:end], out=inner[:, begin:end])
    if not near and own.shape[1]:
        inner -= inner.max(axis=0)
    return inner


def log_probabilities(out_weights, states, targets, block: int = 512) -> np.ndarray:
    """Natural log of the probability of each target symbol, by class and then within the class.

    States are columns with a one below; see `outputs`. Classes are met in blocks of states that stay in the cache.
    """
    wc, wi, near = out_weights
    group, order, heads = by_head(targets)
    out, out_t = np.empty(len(targets), states.dtype), np.ascontiguousarray(wc.T)
    for at in range(0, len(targets), block):
        logits = out_t @ states[:, at : at + block]
        if not near:
            logits -= logits.max(axis=0)
        mine = logits[group[at : at + block], np.arange(logits.shape[1])]
        np.exp(logits, out=logits)
        np.subtract(mine, np.log(logits.sum(axis=0)), out=out[at : at + block])
    inner = within_heads(wi, states.take(order, axis=1, mode="clip"), heads, near)
    inside = inner[targets[order] % CLASS_SIZE, np.arange(len(order))]
    np.exp(inner, out=inner)
    out[order] += inside - np.log(inner.sum(axis=0))
    return out


def log_likelihood(w, states, targets) -> np.ndarray:
    """The same for states in rows."""
    return log_probabilities(outputs(w), with_one(states.T), targets)


def gradients(w, inputs, targets, h):
    """Gradients of one window (steps, lanes) by backpropagation through its steps, and the state after it.

    Those of "x" come for the window's own symbols only, which are the second result. Inside, tokens are columns.
    """
    steps, lanes = inputs.shape
    kind = w["u"].dtype
    wc, wi, near = outputs(w)
    g = {k: np.zeros_like(w[k]) for k in ("u", "wc", "bc", "wi", "bi")}
    flat_inputs, goal = inputs.reshape(-1), targets.reshape(-1)
    scale, number = kind.type(1 / len(goal)), np.arange(lanes)
    group, order, heads = by_head(goal)
    states, back, saved = np.ones((HIDDEN + 1, steps, lanes), kind), [], []
    alive, u, out_t, both = (inputs != 0).astype(kind), np.ascontiguousarray(w["u"].T), np.ascontiguousarray(wc.T), 0
    h = np.ascontiguousarray(h.T, dtype=kind)
    for t in range(steps):
        before = h * alive[t]
        x = np.ascontiguousarray(w["x"].take(inputs[t], axis=0).T)
        x += w["b"][:, None]
        h, kept = advance(u, x, before)
        saved.append((before, *kept))
        mine = with_one(h)
        states[:HIDDEN, t] = h
        error = out_t @ mine
        if not near:
            error -= error.max(axis=0)
        np.exp(error, out=error)
        error *= scale / error.sum(axis=0)
        error[group[t * lanes : (t + 1) * lanes], number] -= scale
        both += mine @ error.T
        back.append(w["wc"] @ error)
    g["wc"][:], g["bc"][:] = both[:HIDDEN], both[HIDDEN]
    own, places = states.reshape(HIDDEN + 1, -1).take(order, axis=1, mode="clip"), goal[order] % CLASS_SIZE
    # tokens of tail classes have no head, and read the last column
    own_back, back_at = np.zeros((HIDDEN, len(order) + 1), kind), np.full(len(goal), len(order))
    back_at[order] = np.arange(len(order))
    inner = within_heads(wi, own, heads, near)
    np.exp(inner, out=inner)
    inner *= scale / inner.sum(axis=0)
    inner[places, np.arange(len(order))] -= scale
    for head, begin, end in heads:
        both = own[:, begin:end] @ inner[:, begin:end].T
        g["wi"][head], g["bi"][head] = both[:HIDDEN], both[HIDDEN]
        np.matmul(w["wi"][head], inner[:, begin:end], out=own_back[:, begin:end])
    carried = np.zeros((HIDDEN, lanes), kind)
    dx = np.empty((3 * HIDDEN, steps, lanes), kind)
    for t in reversed(range(steps)):
        before, z, r, n, an = saved[t]
        d = own_back.take(back_at[t * lanes : (t + 1) * lanes], axis=1, mode="clip")
        d += back[t]
        d += carried
        rest = d * (1 - z)
        dn = rest * (1 - n * n)
        da = np.empty((3 * HIDDEN, lanes), kind)
        da[:HIDDEN] = rest * (before - n) * z
        np.multiply(dn, r, out=da[2 * HIDDEN :])
        da[HIDDEN : 2 * HIDDEN] = da[2 * HIDDEN :] * an * (1 - r)
        dx[: 2 * HIDDEN, t], dx[2 * HIDDEN :, t] = da[: 2 * HIDDEN], dn
        g["u"] += before @ da.T
        d *= z
        d += w["u"] @ da
        d *= alive[t]
        carried = d
    dx = dx.reshape(3 * HIDDEN, -1)
    g["b"] = dx.sum(axis=1)
    met = np.zeros(SYMBOLS, dtype=bool)
    met[flat_inputs] = True
    rows = np.flatnonzero(met)
    place = (np.cumsum(met) - 1)[flat_inputs]
    g["x"] = np.ascontiguousarray(np.array([np.bincount(place, column, len(rows)) for column in dx]).T, dtype=kind)
    return g, rows, h.T


def train(w, symbols: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """One pass of Adam over the concatenated targets of many texts, each ended by symbol 0."""
    lanes = int(np.clip(len(symbols) // 2048, 4, 512))
    length = len(symbols) // lanes
    targets = symbols[: lanes * length].reshape(lanes, length).T
    inputs = np.concatenate((np.zeros((1, lanes), targets.dtype), targets))[:length]
    windows = [(inputs[at : at + STEPS], targets[at : at + STEPS]) for at in range(0, length, STEPS)]
    # the few symbols that fill no lane are a last window of their own
    rest = symbols[lanes * length :, None]
    if len(rest):
        windows.append((np.concatenate((np.zeros((1, 1), rest.dtype), rest[:-1])), rest))
    h = np.zeros((lanes, HIDDEN), np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    seen = np.zeros(SYMBOLS, dtype=np.int64)
    for number, (before, after) in enumerate(windows, 1):
        h = h if before.shape[1] == len(h) else np.zeros((before.shape[1], HIDDEN), np.float32)
        g, rows, h = gradients(w, before, after, h)
        norm = math.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        size = rate * math.sqrt(1 - 0.99**number) / (1 - 0.9**number)
        # a symbol's moments fade for the windows it was absent from when it comes again
        idle = (number - seen[rows])[:, None].astype(np.float32)
        seen[rows] = number
        for k, v in g.items():
            at, old, faded = (rows, np.float32(0.9) ** idle, np.float32(0.99) ** idle) if k == "x" else (..., np.float32(0.9), np.float32(0.99))
            v *= clip
            one = first[k][at] * old
            one += 0.1 * v
            v *= v
            v *= 0.01
            two = second[k][at] * faded
            two += v
            first[k][at], second[k][at] = one, two
            np.sqrt(two, out=v)
            v += 1e-8
            np.divide(one, v, out=v)
            v *= size
            w[k][at] -= v
    return w


def flatten(w) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unflatten(vector: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        out[k] = vector[at : at + math.prod(shape)].reshape(shape).astype(np.float32)
        at += math.prod(shape)
    return out


def symbols_of(texts: pa.Array, vocabulary: Vocabulary):
    """Distinct words with their facts, and for every token its word and text; sizes by text."""
    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    symbols, counts, listed = vocabulary.look_up(coded.dictionary)
    return coded, symbols, counts, listed, sizes


ENCODED = (
    "key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, inner double, pick long, ids array<int>, "
    "words array<string>, times array<long>"
)


def encode_batches(batches, vocabulary: Vocabulary):
    """Per text: token counts, its partial scores in log10, its symbols (the end last), and its rare words with their numbers."""
    v = vocabulary
    number = TaskContext.get().partitionId() << 36
    static = np.log10(v.tail_tokens + v.tail_words + 1)
    for part in slices(batches, 6000, 1_000_000):
        coded, symbols, counts, listed, sizes = symbols_of(part.column("content"), v)
        index = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        flat = symbols[index] if len(index) else np.zeros(0, np.int64)
        with_end = np.insert(flat, np.cumsum(sizes), 0).astype(np.int32)
        known = np.log10(counts + 1.0)
        inner = np.where(symbols >= SHORT, known - static[np.maximum(symbols - SHORT, 0)], 0.0)

        def total(values, doc=doc, index=index, n=len(sizes)):
            return np.bincount(doc, values[index], n) if len(index) else np.zeros(n)

        rare = ~listed[index] if len(index) else np.zeros(0, dtype=bool)
        key, times = np.unique(doc[rare] * np.int64(len(listed) + 1) + index[rare], return_counts=True)
        owner, word = key // (len(listed) + 1), key % (len(listed) + 1)
        bounds = pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32())
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(number + np.arange(len(sizes))), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
            "n_tokens": pa.array(sizes + 1, pa.int64()),
            "n_known": pa.array(total(listed.astype(float)).astype(np.int64) + (v.texts > 0)),
            "base": pa.array(total(known) + math.log10(v.texts + 1)), "inner": pa.array(total(inner)), "pick": part.column("pick"),
            "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes + 1))), pa.int32()), pa.array(with_end)),
            "words": pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(word)).cast(pa.string())),
            "times": pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64())),
        })
        number += len(sizes)


def encode_rows(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The stored symbols of (doc_id, held_out, content) rows; learning and scoring read them, so words are looked up once."""
    shared = ship(rows.sparkSession, vocabulary)
    # dealt by row, so copies of a text meet several rounds and no text stands or falls as a whole
    picked = rows.select("doc_id", "held_out", F.xxhash64("doc_id", "content").alias("pick"), "content")
    schema = ENCODED.format(kind=rows.schema["doc_id"].dataType.simpleString())
    return store(picked.mapInArrow(lambda batches: encode_batches(batches, unpack(shared)), schema), "lm-rows")


def fit_network(texts: DataFrame, vocabulary: Vocabulary, share: int = 1, rounds: int = 4, shard_tokens: int = 6_000_000) -> dict[str, np.ndarray]:
    """The network of (doc_id, content) rows; see `learn_rows`."""
    return learn_rows(encode_rows(texts.withColumn("held_out", F.lit(False)), vocabulary), vocabulary, share, rounds, shard_tokens)


def learn_rows(
    encoded: DataFrame, vocabulary: Vocabulary, share: int = 1, rounds: int = 4, shard_tokens: int = 6_000_000
) -> dict[str, np.ndarray]:
    """One pass over one in `share` of the rows not held out, one part of them in each round.

    Copies of the network learn on parts of about `shard_tokens` tokens and are averaged after each round.
    """
    spark = encoded.sparkSession
    number = F.pmod("pick", F.lit(share * rounds))
    sample = encoded.where("NOT held_out").select(number.alias("pick"), "n_tokens", "ids").where(F.col("pick") < rounds)
    tokens = {r["pick"]: r["n"] for r in sample.groupBy("pick").agg(F.sum("n_tokens").alias("n")).collect()}
    weights = flatten(new_weights(vocabulary))
    for turn in sorted(tokens):
        now = ship(spark, weights)

        def learn(batches, turn=turn, now=now):
            parts = [b.column("ids") for b in batches if b.num_rows]
            if not parts:
                return
            symbols = np.concatenate([p.flatten().to_numpy() for p in parts])
            learned = flatten(train(unflatten(unpack(now)), symbols, 0.006 / (1 + turn)))
            yield pa.RecordBatch.from_arrays([pa.array([learned.tobytes()], pa.binary()), pa.array([len(symbols)], pa.int64())], ["w", "n"])

        shards = math.ceil(tokens[turn] / shard_tokens)
        parts = sample.where(F.col("pick") == turn).select("ids").repartition(shards)
        copies = parts.mapInArrow(learn, "w binary, n long").rdd.map(lambda r: (np.frombuffer(r["w"], np.float32) * float(r["n"]), r["n"]))
        # about sixteen copies meet at the driver, however many shards there are
        total, n = copies.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=max(2, math.ceil(math.log(shards, 16))))
        weights = (total / n).astype(np.float32)
    return unflatten(weights)


# ---- scoring ------------------------------------------------------------------------------------------------------

KEPT = ("key", "doc_id", "held_out", "n_tokens", "n_known", "base")


def deal_lanes(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts dealt to lanes of like total length: the texts lane by lane, longest lane first, and each lane's texts and tokens."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    dealt, loads = [[] for _ in range(lanes)], [(0, lane) for lane in range(lanes)]
    for text, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        load, lane = loads[0]
        dealt[lane].append(text)
        heapq.heapreplace(loads, (load + size, lane))
    loads = sorted(((load, lane) for load, lane in loads if load), key=lambda pair: -pair[0])
    texts = np.array([text for _, lane in loads for text in dealt[lane]], dtype=np.int64)
    return texts, np.array([len(dealt[lane]) for _, lane in loads], np.int64), np.array([load for load, _ in loads], np.int64)


def score_symbols(w, symbols: np.ndarray, sizes: np.ndarray, tile: int = 512, together: int = 8192) -> np.ndarray:
    """Natural log-likelihood of each text's symbols (its end included, which is the only 0).

    Up to `tile` lanes run side by side, each one text after the other; the state is cleared at a text's start. About
    `together` states meet the output weights at once, however few lanes are left.
    """
    out = np.zeros(len(sizes))
    texts, of_lane, loads = deal_lanes(sizes, min(tile, len(sizes)))
    if not len(texts):
        return out
    starts = np.cumsum(sizes) - sizes
    length = sizes[texts]
    # the symbols lane by lane
    symbols = symbols[np.repeat(starts[texts] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
    begin, owner = np.cumsum(loads) - loads, np.cumsum(of_lane) - of_lane
    # how many lanes still run at each step
    running = len(loads) - np.searchsorted(loads[::-1], np.arange(int(loads[0])), side="right")
    out_weights, u, x = outputs(w), np.ascontiguousarray(w["u"].T), w["x"] + w["b"]
    states = np.ones((HIDDEN + 1, together + len(loads)), x.dtype)
    goals, owners = np.empty(together + len(loads), symbols.dtype), np.empty(together + len(loads), np.int64)
    h, total, held = np.zeros((HIDDEN, len(loads)), x.dtype), np.zeros(len(texts)), 0
    inputs = np.zeros(len(loads), symbols.dtype)
    for t, n in enumerate(running.tolist()):
        h, inputs = h[:, :n], inputs[:n]
        fresh = np.flatnonzero(inputs == 0)
        if t and len(fresh):
            h[:, fresh] = 0
            owner[fresh] += 1
        h = advance(u, np.ascontiguousarray(x.take(inputs, axis=0).T), h)[0]
        inputs = symbols[begin[:n] + t]
        here = slice(held, held + n)
        states[:HIDDEN, here], goals[here], owners[here] = h, inputs, owner[:n]
        held += n
        if held >= together or t + 1 == len(running):
            total += np.bincount(owners[:held], log_probabilities(out_weights, states[:, :held], goals[:held]), len(texts))
            held = 0
    out[texts] = total
    return out


def score_rows(batches, w, together: int = 2_000_000):
    """Encoded rows with the network's log10 probability of their texts.

    About `together` tokens, 4 bytes each, go through the network side by side.
    """
    waiting, tokens = [], 0

    def scored():
        logs = score_symbols(w, np.concatenate([p[0] for p in waiting]), np.concatenate([p[1] for p in waiting])) / LOG10
        at = 0
        for _, sizes, part in waiting:
            score = logs[at : at + len(sizes)] + part.column("inner").to_numpy()
            at += len(sizes)
            yield pa.RecordBatch.from_arrays([*(part.column(name) for name in KEPT), pa.array(score)], [*KEPT, "score"])

    for part in batches:
        if not part.num_rows:
            continue
        ids, sizes = part.column("ids").flatten().to_numpy(), part.column("n_tokens").to_numpy()
        waiting.append((ids, sizes, part.select([*KEPT, "inner"])))
        tokens += len(ids)
        if tokens > together:
            yield from scored()
            waiting, tokens = [], 0
    if waiting:
        yield from scored()
    give_back()


def score_documents(docs: DataFrame, held_out: Column, known_words: int = 200_000, share: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs` (doc_id, text).

    Counts and the network's weights come from all rows for which `held_out` is false (the weights from one in `share`).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), text_or_empty().alias("content"))
    vocabulary, rare_counts = fit_vocabulary(rows.where("NOT held_out").select("doc_id", "content"), known_words)
    encoded = encode_rows(rows, vocabulary)
    model = ship(spark, learn_rows(encoded, vocabulary, share))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = store(encoded.select(*KEPT, "inner", "ids").mapInArrow(
        lambda batches: score_rows(batches, unpack(model)),
        f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double",
    ), "lm-scores")
    rare = encoded.select("key", F.explode(F.arrays_zip("words", "times")).alias("r")).select("key", F.col("r.words").alias("word"), "r.times")
    sums = rare.join(rare_counts, "word").groupBy("key").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs")
    )
    n = math.log10(vocabulary.tokens + vocabulary.distinct + 1)
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs - n * F.col("n_tokens")).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
