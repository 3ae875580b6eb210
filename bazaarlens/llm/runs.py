"""Periodic runs of words: block convolution by an exact integer transform at dyadic scales.

A run is a stretch of words with smallest period q and at least max(`least`, 2q) words that no neighbour extends. A run of period q
holds a stretch of at least max(q, `least` - q) words that equal the words q places on. So at scale B (2, 4, 8, ...) some block of
B words that begins at a multiple of B lies in the stretch, for every q from 2B to 4B - 1 (1 to 7 at the smallest scale).

Each block is compared with all places of its following window at once: the sum of squared differences between a block p and the
window t at offset o is sum(p^2) + sum(t^2) - 2 sum(p t), and the last sum over all offsets is a cyclic correlation, computed by a
number-theoretic transform modulo 65537 in integers, without rounding. Words enter as residues, so a sum that is not zero modulo the
prime is a mismatch for certain, and a zero is confirmed word by word. Blocks with a word that does not return within 4B words
cannot have an occurrence there and are passed over, as are blocks well inside a run of period at most B, which hold no other run.
Distances of confirmed occurrences seed extensions to both sides, word by word; a stretch counts if its period is the smallest
one, i.e. no period / prime factor fits.

Periods beyond 65535 words take blocks of 16384 words and several windows each, so no length of text is left out; a text is held by
one task. A null text has no words and no runs, its collapsed text is empty. Repeated rows are searched once each; null ids stay;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import mix64, slices, split_words, text_or_empty

PRIME, GENERATOR = 65537, 3  # 2^16 + 1: roots of unity of every power of two up to 2^16
LONGEST = 1 << 14  # words of the longest block, whose transform has 2^16 places
CELLS = 1 << 18  # numbers transformed at a time
STEPS = 16  # words that all extensions take side by side; longer ones go on alone


# ---- the transform ------------------------------------------------------------------------------------------------

def fold(x: np.ndarray) -> np.ndarray:
    """A smaller number congruent to x, as 2^16 is -1."""
    return (x & 0xFFFF) - (x >> 16)


@lru_cache(maxsize=64)
def powers(size: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a primitive root of unity of order `size` (of its inverse)."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(max(size // 2, 1), dtype=np.int64)
    for i in range(1, len(out)):
        out[i] = out[i - 1] * root % PRIME
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Transform of each column of x (size, columns); the places come in bit-reversed order. Overwrites x."""
    size, columns = x.shape
    half = size // 2
    while half:
        pairs = x.reshape(-1, 2, half, columns)
        a, b = pairs[:, 0], pairs[:, 1]
        difference = (a - b) * powers(2 * half, False)[:, None]
        a += b
        b[:] = fold(difference)
        half //= 2
    return fold(fold(x))


def inverse(x: np.ndarray) -> np.ndarray:
    """The inverse of `transform`, as numbers from 0 to 65536. Overwrites x."""
    size, columns = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(-1, 2, half, columns)
        a, b = pairs[:, 0], pairs[:, 1]
        turned = fold(b * powers(2 * half, True)[:, None])
        b[:] = a - turned
        a += turned
        half *= 2
    return x % PRIME * pow(size, -1, PRIME) % PRIME


def occurrences(values: np.ndarray, starts: np.ndarray, block: int, first: int, count: int, stops: np.ndarray):
    """Pairs (start, distance) with zero squared difference modulo the prime, for distances first ... first + count - 1.

    `values` are the residues of all texts in a row, `stops` the end of each block's text; count <= 3 * block + 1 - ... <= 4 * block.
    """
    size = 1 << (block + count - 2).bit_length()
    squares = np.concatenate(([0], np.cumsum(values * values)))
    found = []
    offsets = np.arange(count)
    for at in range(0, len(starts), max(1, CELLS // size)):
        some, stop = starts[at : at + max(1, CELLS // size)], stops[at : at + max(1, CELLS // size)]
        places = np.arange(block + count - 1)[:, None] + some + first
        window = np.zeros((size, len(some)), dtype=np.int64)
        window[: len(places)] = values[np.minimum(places, len(values) - 1)]
        pattern = np.zeros((size, len(some)), dtype=np.int64)
        pattern[-np.arange(block)] = values[np.arange(block)[:, None] + some]
        products = inverse(fold(transform(window) * transform(pattern)))[:count]
        begin = offsets[:, None] + some + first
        inside = begin + block <= stop
        begin = np.where(inside, begin, 0)
        sums = squares[begin + block] - squares[begin] + squares[some + block] - squares[some] - 2 * products
        offset, column = np.nonzero(inside & (sums % PRIME == 0))
        found.append((some[column], offset + first))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part).astype(np.int64) for part in zip(*found, strict=True))


# ---- runs ---------------------------------------------------------------------------------------------------------

def returns_after(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word, how many words later the same text has it again; 2^62 if never."""
    gap = np.full(len(codes), 1 << 62, dtype=np.int64)
    order = np.argsort(owner * np.int64(codes.max() + 1) + codes, kind="stable")
    same = (codes[order[1:]] == codes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


def gallop(codes, a: int, b: int, step: int, limit: int) -> int:
    """How many words from a and b on (backwards if step is -1) are equal, at most `limit`."""
    done, width = 0, 64
    while done < limit:
        width = min(width, limit - done)
        if step > 0:
            equal = codes[a + done : a + done + width] == codes[b + done : b + done + width]
        else:
            equal = (codes[a - done - width + 1 : a - done + 1] == codes[b - done - width + 1 : b - done + 1])[::-1]
        if not equal.all():
            return done + int(equal.argmin())
        done += width
        width *= 2
    return done


def extend(codes, begin, end, distance, low, high):
    """Stretches [begin, end) of words equal to those `distance` on, extended both ways within [low, high)."""
    begin, end = begin.copy(), end.copy()
    for _ in range(STEPS):
        go = np.flatnonzero(begin > low)
        go = go[codes[begin[go] - 1] == codes[begin[go] - 1 + distance[go]]]
        begin[go] -= 1
        far = np.flatnonzero(end + distance < high)
        far = far[codes[end[far]] == codes[end[far] + distance[far]]]
        end[far] += 1
        if not len(go) and not len(far):
            return begin, end
    for i in go:
        begin[i] -= gallop(codes, begin[i] - 1, begin[i] - 1 + distance[i], -1, begin[i] - low[i])
    for i in far:
        end[i] += gallop(codes, end[i], end[i] + distance[i], 1, high[i] - end[i] - distance[i])
    return begin, end


def prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] if n > 1 else out


def smallest(codes, begin: int, end: int, period: int) -> bool:
    """Whether no shorter period fits words [begin, end), which have `period` and at least twice as many words."""
    for f in prime_factors(period):
        q = period // f
        if gallop(codes, begin, begin + q, 1, end - begin - q) == end - begin - q:
            return False
    return True


def confirmed(codes, starts, distances, block: int) -> np.ndarray:
    """Which blocks equal the words at their distance, word by word."""
    out = np.zeros(len(starts), dtype=bool)
    for at in range(0, len(starts), max(1, CELLS // block)):
        places = starts[at : at + max(1, CELLS // block), None] + np.arange(block)
        out[at : at + len(places)] = (codes[places] == codes[places + distances[at : at + len(places), None]]).all(axis=1)
    return out


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (among all words), end and period of every run of the texts, whose words' codes stand in a row; by start, then period."""
    none = np.zeros(0, dtype=np.int64)
    if not len(codes) or sizes.max() < least:
        return none, none, none
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = (mix64(codes + 1) % np.uint64(PRIME)).astype(np.int64)
    gap = returns_after(codes, owner)
    runs: set[tuple[int, int, int]] = set()
    scale = 2
    while scale == 2 or 4 * scale <= sizes.max():
        block = min(scale, LONGEST)
        lowest, highest = (1 if scale == 2 else 2 * scale), 4 * scale
        texts = np.flatnonzero(sizes >= max(block + lowest, least))
        per_text = sizes[texts] // scale
        starts = np.repeat(begins[texts], per_text) + scale * (np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        stops = np.repeat(ends[texts], per_text)
        near = np.concatenate(([0], np.cumsum(gap < highest)))
        inside = np.minimum(starts + block, len(codes))
        keep = (near[inside] - near[starts] == block) & (starts + block + lowest <= stops)
        starts, stops = starts[keep], stops[keep]
        covered = np.zeros(0, dtype=np.int64)
        short = [r for r in runs if r[2] <= block]
        if short and len(starts):
            covered = np.zeros(len(codes), dtype=np.int64)
            np.maximum.at(covered, [r[0] for r in short], [r[1] for r in short])
            covered = np.maximum.accumulate(covered)
            keep = covered[starts] < np.minimum(starts + highest + block, stops)
            starts, stops = starts[keep], stops[keep]
        width = min(highest - lowest, 2 * block) if scale > 2 else highest - lowest
        for first in range(lowest, highest, width):
            near_starts = starts + first + block <= stops
            s, d = occurrences(values, starts[near_starts], block, first, width, stops[near_starts])
            if len(covered):
                keep = covered[s] < s + d + block
                s, d = s[keep], d[keep]
            keep = confirmed(codes, s, d, block)
            s, d = s[keep], d[keep]
            if not len(s):
                continue
            # blocks in a row with one distance are one stretch (whole blocks only: longer scales leave places between them)
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            fresh = np.concatenate(([True], (s[1:] != s[:-1] + block) | (d[1:] != d[:-1]) | (owner[s[1:]] != owner[s[:-1]])))
            head = np.flatnonzero(fresh)
            tail = np.concatenate((head[1:], [len(s)])) - 1
            text = owner[s[head]]
            begin, end = extend(codes, s[head], s[tail] + block, d[head], begins[text], ends[text])
            length = end - begin + d[head]
            long = length >= np.maximum(least, 2 * d[head])
            for b, e, q in {*zip(begin[long].tolist(), (end + d[head])[long].tolist(), d[head][long].tolist(), strict=True)} - runs:
                if smallest(codes, b, e, q):
                    runs.add((b, e, q))
        scale *= 2
    if not runs:
        return none, none, none
    table = np.array(sorted(runs, key=lambda r: (r[0], r[2])), dtype=np.int64)
    return table[:, 0], table[:, 1], table[:, 2]


# ---- the operator -------------------------------------------------------------------------------------------------

RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def search_texts(batches, least: int):
    for part in slices(batches, 4000):
        words, sizes = split_words(part.column("content"), lower=False)
        sizes = sizes.astype(np.int64)
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
        start, end, period = find_runs(codes, sizes, least)
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, start, side="right")
        bounds = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
        change = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change[:-1]) == 0
        left = np.concatenate(([0], np.cumsum(kept)))
        of_text = pa.LargeListArray.from_arrays(pa.array(left[np.concatenate(([0], ends))]), words.filter(pa.array(kept)).cast(pa.large_string()))
        collapsed = pc.binary_join(of_text, pa.scalar(" ", pa.large_string())).cast(pa.string())
        found = pa.StructArray.from_arrays(
            [pa.array(start - (ends - sizes)[text]), pa.array(end - start), pa.array(period)], ["start", "length", "period"]
        )
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(bounds, found), collapsed], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """doc_id, runs (start word, length, period; by start, then period) and the text with each run cut to its first period.

    Words of the collapsed text are joined by one space. Needs no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty(text).alias("content"))
    return rows.mapInArrow(lambda batches: search_texts(batches, least), f"doc_id {kind}, {RUNS}")


def digests(found: DataFrame) -> DataFrame:
    """Per row of `periodic_runs`: number of runs, the longest run, digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    sized = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), ended.alias("lines"), "collapsed")
    return sized.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div -best.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text, where each text with h = crc32(doc_id) divisible by 10 repeats from word a on with period p.

    g = floor(h / 10), a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)) for n words; its words are joined by one space. Other
    texts, those without words and those without id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    sized = planted.withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long")))
    placed = sized.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at(
        "w", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")
    ))
    return placed.select("doc_id", F.coalesce(F.array_join(moved, " "), F.col("text")).alias("text"))
