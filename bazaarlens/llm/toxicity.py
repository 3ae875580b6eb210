"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: words and word beginnings (3 to 6 characters) whose share among toxic texts is larger than among
clean ones, by the lower confidence bound of the log odds. Features are lexicon densities and peaks, proximity of lexicon
words to second-person pronouns, rates of capitals, exclamation marks and other punctuation, and obfuscation rates (symbols
or digits inside words, repeated characters, spelled-out letters). Labelled rows are split three ways by hash: lexicon,
trees, calibration, so that no part judges its own training rows. All three come from at most `max_rows` labelled rows.

Scores are in [0, 1] for every text, null and empty ones included. Repeated rows get equal scores. Without labelled rows of
both kinds the score is the share of toxic ones (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import give_back, ship, slices, split_words, store, text_or_empty, unpack

#: Second-person pronouns of the languages served.
SECOND_PERSON = (
    "you your yours yourself u ur thou thee du dich dir dein deine deinen deinem deiner euch euer ihr sie ihnen tu te toi "
    "ton ta tes vous votre vos usted ustedes ti tú vosotros vuestro su"
).split()
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("0134578@$!|€", "oleastbasiie")
FEATURES = (
    "hits", "hit_density", "weight_density", "peak", "second_peak", "prefix_hits", "prefix_density", "near_you",
    "you_density", "capitals", "shouted_words", "exclamations", "punctuation", "obfuscated", "disguised_hits", "log_words",
)
EDGE = ".,;:!?\"'()[]{}<>*_~-…«»“”„"


@dataclass
class Trees:
    """Boosted trees of equal depth as arrays: feature and threshold per inner node, value per leaf."""

    start: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (leaf.size - 1)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(base / (1 - base)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, inner = np.full(len(x), start), 2**depth - 1
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                size = len(cuts[j]) + 1
                slot = (node - first) * size + codes[:, j]
                g = np.bincount(slot, gradient, width * size).reshape(width, size).cumsum(axis=1)
                h = np.bincount(slot, curvature, width * size).reshape(width, size).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = gain[:, :-1]
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better], threshold[first + better] = j, cuts[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, curvature, inner + 1)
        value = rate * g / (h + ridge)
        margin += value[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(value)
    return Trees(start, np.array(all_features), np.array(all_thresholds), np.array(all_leaves))


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, values), each block shrunk by half a row of either kind."""
    blocks: list[list[float]] = []  # sum, rows, first score, last score
    unique, inverse = np.unique(score, return_inverse=True)
    sums, rows = np.bincount(inverse, y), np.bincount(inverse)
    for s, total, n in zip(unique, sums, rows, strict=True):
        blocks.append([total, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    values = np.array([v for b in blocks for v in [(b[0] + 0.05) / (b[1] + 0.1)] * 2])
    return knots, np.maximum.accumulate(values)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: Trees | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None
    share: float = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.share)
        return np.clip(np.interp(self.trees.margin(features), self.knots, self.values), 0, 1)


def terms(word: str) -> list[str]:
    """A bare word and its beginnings, marked `word` and `beginning*`."""
    return [word, *(f"{word[:k]}*" for k in range(3, 7) if len(word) > k)]


def word_facts(words: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """Per distinct word: lexicon weight, is a beginning's, pronoun, capitals, letters, shouted, !, punctuation, obfuscated, disguised."""
    facts = np.zeros((len(words), 10), dtype=np.float32)
    pronouns = frozenset(SECOND_PERSON)
    for i, word in enumerate(words):
        low = word.lower()
        bare = low.strip(EDGE)
        weight, beginning = lexicon.get(bare, 0.0), 0
        for k in range(3, 7):
            if len(bare) > k and (w := lexicon.get(f"{bare[:k]}*", 0.0)) > weight:
                weight, beginning = w, 1
        mixed = not bare.isalpha() and any(map(str.isalpha, bare)) and len(bare) > 2
        repeated = len(bare) > 3 and any(bare[j] == bare[j + 1] == bare[j + 2] for j in range(len(bare) - 2))
        disguised = 0
        if (mixed or repeated) and not weight:
            plain = low.strip(".,;:?\"'").translate(DISGUISE)
            plain = "".join(c for j, c in enumerate(plain) if c.isalpha() and (j < 2 or not c == plain[j - 1] == plain[j - 2]))
            weight = lexicon.get(plain, 0.0)
            disguised = int(weight > 0)
        letters = sum(map(str.isalpha, word)) if not word.isalpha() else len(word)
        upper = 0 if word.islower() else sum(map(str.isupper, word))
        facts[i] = (
            weight, beginning * (weight > 0), bare in pronouns, upper, letters, letters > 2 and upper == letters,
            word.count("!"), len(word) - letters, mixed or repeated, disguised,
        )
    return facts


def text_features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """Feature rows (FEATURES) of all texts, over all their words."""
    words, sizes = split_words(texts, lower=False)
    n = len(sizes)
    out = np.zeros((n, len(FEATURES)))
    if not len(words):
        return out
    coded = words.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    facts = word_facts(coded.dictionary.to_pylist(), lexicon)
    index = coded.indices.to_numpy()
    doc = np.repeat(np.arange(n), sizes)
    count = np.maximum(sizes, 1)

    def total(values):
        return np.bincount(doc, values, n)

    weight = facts[:, 0][index]
    hit, you = weight > 0, facts[:, 2][index] > 0
    hits = total(hit)
    at, spots = np.flatnonzero(hit), np.flatnonzero(you)
    near = np.zeros(n)
    if len(at) and len(spots):
        right = np.searchsorted(spots, at)
        gap = np.full(len(at), 1e9)
        for side in (np.minimum(right, len(spots) - 1), np.maximum(right - 1, 0)):
            same = doc[spots[side]] == doc[at]
            gap = np.where(same, np.minimum(gap, np.abs(spots[side] - at)), gap)
        np.maximum.at(near, doc[at], 1 / (1 + gap))
    peak, second = np.zeros(n), np.zeros(n)
    if len(at):
        # strongest and second strongest distinct word of each text
        order = np.lexsort((index[at], -weight[at], doc[at]))
        d, w, token = doc[at][order], weight[at][order], index[at][order]
        fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (token[1:] != token[:-1])))
        d, w = d[fresh], w[fresh]
        begin = np.concatenate(([True], d[1:] != d[:-1]))
        peak[d[begin]] = w[begin]
        follow = np.concatenate(([False], begin[:-1])) & ~begin
        second[d[follow]] = w[follow]
    letters = np.maximum(total(facts[:, 4][index]), 1)
    prefixed = total(facts[:, 1][index])
    out[:] = np.stack([
        hits, hits / count, total(weight) / count, peak, second, prefixed, prefixed / count, near, total(you) / count,
        total(facts[:, 3][index]) / letters, total(facts[:, 5][index]) / count, total(facts[:, 6][index]) / count,
        total(facts[:, 7][index]) / letters, total(facts[:, 8][index]) / count, total(facts[:, 9][index]), np.log1p(sizes),
    ], axis=1)
    return out


def learn_lexicon(rows: DataFrame, size: int, least: int) -> dict[str, float]:
    """Terms of (content, toxic) rows by lower confidence bound of their log odds: the `size` strongest with at least `least` toxic texts."""

    def count(batches):
        for part in slices(batches, 500):
            found: dict[str, list[int]] = {}
            for text, toxic in zip(part.column("content").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                for term in {t for w in {w.strip(EDGE) for w in text.lower().split()} if w for t in terms(w)}:
                    found.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([v[1] for v in found.values()], pa.int64()),
                 pa.array([v[0] for v in found.values()], pa.int64())], ["term", "toxic", "clean"],
            )

    totals = rows.groupBy("toxic").count().collect()
    n = {int(r["toxic"]): r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        return {}
    sums = rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).where(F.col("toxic") >= least)
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    bound = odds - 2.0 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = sums.select("term", bound.alias("weight")).where("weight > 0.5").orderBy(F.desc("weight"), "term").limit(size)
    return {r["term"]: float(r["weight"]) for r in top.collect()}


def text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def sample_texts(labels: DataFrame, texts: DataFrame, max_texts: int = 24_000) -> DataFrame:
    """A bounded sample (pick, content, toxic), stored: the `max_texts` distinct texts with the smallest hashes, each once.

    `labels` holds (pick, toxic) rows, pick being the `text_hash` of a text of `texts`; copies add nothing to the sample. A
    text counts as toxic if at least half of its labels do. Only hashes are grouped; texts are read for the chosen ones alone.
    """
    known = labels.where("toxic IN (0, 1)")
    chosen = known.groupBy("pick").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).orderBy("pick").limit(max_texts)
    hashed = texts.select(text_hash().alias("pick"), text_or_empty().alias("content"))
    return store(hashed.join(F.broadcast(chosen), "pick").dropDuplicates(["pick"]), "toxicity-texts")


def learn_toxicity(labelled: DataFrame, max_texts: int = 24_000, lexicon_size: int = 3000, least: int = 4) -> ToxicityModel:
    """Fit on a sample made by `sample_texts`, or on such a sample of (text, toxic) rows with toxic 0 or 1."""
    rows = labelled
    if "pick" not in labelled.columns:
        rows = sample_texts(labelled.select(text_hash().alias("pick"), F.col("toxic").cast("int").alias("toxic")), labelled, max_texts)
    counts = rows.agg(F.count("*").alias("n"), F.avg("toxic").alias("share")).first()
    if not counts["n"] or counts["share"] in (0.0, 1.0):
        return ToxicityModel(share=float(counts["share"] or 0.0))
    part = F.pmod(F.xxhash64(F.lit(5), F.pmod("pick", F.lit(1 << 40))), F.lit(10))
    lexicon = learn_lexicon(rows.where(part < 4), lexicon_size, least)

    def features(batches):
        for some in slices(batches, 500):
            values = text_features(some.column("content"), lexicon)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(values), pa.list_(pa.float64())), some.column("toxic"), some.column("part")], ["x", "toxic", "part"]
            )

    made = rows.where(part >= 4).select("content", "toxic", part.alias("part")).mapInArrow(
        features, "x array<double>, toxic int, part long"
    ).toArrow()
    if not made.num_rows:
        return ToxicityModel(share=float(counts["share"]))
    x = np.array(made.column("x").to_pylist())
    y, p = made.column("toxic").to_numpy().astype(float), made.column("part").to_numpy()
    order = np.lexsort((*x.T, y, p))
    x, y, p = x[order], y[order], p[order]
    grow, tune = p < 8, p >= 8
    if len(set(y[grow])) < 2 or len(set(y[tune])) < 2:
        grow = tune = np.ones(len(y), dtype=bool)
    if len(set(y)) < 2:
        return ToxicityModel(share=float(counts["share"]))
    trees = fit_trees(x[grow], y[grow])
    knots, values = fit_isotonic(trees.margin(x[tune]), y[tune])
    return ToxicityModel(lexicon, trees, knots, values, float(counts["share"]))


def toxicity_score(spark, model: ToxicityModel):
    """A function from a text column to a column of scores."""
    shared = ship(spark, model)

    def score(batches):
        m = unpack(shared)
        for texts in batches:
            parts = [m.score(text_features(texts.slice(i, 500), m.lexicon)) for i in range(0, len(texts), 500)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        give_back()

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(score, "double")

    def column(text: Column) -> Column:
        return udf(F.coalesce(text.cast("string"), F.lit("")))

    return column
