"""Near-duplicate groups by HyperMinHash signatures, banding, corrected estimates and exact confirmation.

A document's set is its distinct `width`-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a shorter text is one
shingle; no words: no set, linked with nothing). A signature has one register for each of 128 buckets; a bucket has a hash
function of its own under which every shingle is seen, so short texts leave none empty, and it stores the leading-zero count
(6 bits) and the 10 bits that follow of the smallest hash. Four registers make a band key. Pairs that share a key are
estimated from their registers, with the chance agreement of the compressed registers taken out, and those not clearly
below the threshold are confirmed on their full sets.

Documents with equal sets form a class at once. Pairs are never listed for a whole bucket: in each round every member not
yet in the component of its bucket's centre is compared with that centre, and components are contracted. After that the
registers of members of different components in one bucket are compared in blocks, plausible pairs are confirmed there, and
only links that tie components together come out.
Every pair that shares a band and is not connected otherwise is so compared, whatever the size of its bucket. With 32 bands, a pair at similarity 0.8 shares none with probability 5e-8.

Null doc_id: its text counts for no component; it is kept if no other row has its set. Rows that share a doc_id are one
document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import mix64, slices, split_words, store, text_or_empty
from bazaarlens.llm.components import connected_components

REGISTERS, ROWS_PER_BAND, MANTISSA = 128, 4, 10
#: estimates this far below the threshold are not confirmed: over five standard deviations of 128 registers at 0.8
MARGIN = 0.2
#: bands whose buckets have centres in the first round: enough to tie large groups together before all bands are used
FIRST_BANDS = 3

with np.errstate(over="ignore"):
    _SEEDS = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FLIP, FACTOR = _SEEDS[:REGISTERS, None], _SEEDS[REGISTERS:, None] | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    import xxhash

    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = hashed[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    place = mix64(np.arange(1, width + 1, dtype=np.uint64))
    stops = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        span = max(len(word) - width + 1, 0)
        run = np.zeros(span, np.uint64)
        for k in range(width):
            run += word[k : k + span] * (place[k] | np.uint64(1))
        run = mix64(run)
        out = []
        for size, stop in zip(sizes.tolist(), stops.tolist(), strict=True):
            if size >= width:
                out.append(np.unique(run[stop - size : stop - width + 1]))
            elif size:
                alone = (word[stop - size : stop] * (place[:size] | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(size)
                out.append(mix64(np.array([alone], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest_of(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers (unsigned 16 bits: leading zeros, then mantissa) of a non-empty set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 2048):
        with np.errstate(over="ignore"):
            seen = (hashes[None, start : start + 2048] ^ FLIP) * FACTOR
        np.minimum(least, seen.min(axis=1), out=least)
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64))), 0, 63).astype(np.uint64)
    bits = (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | bits).astype("<u2")


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m shingles are equal: same leading zeros, same mantissa."""
    zeros = np.arange(64)[:, None]
    low, high = 0.5 ** (zeros + 1), 0.5**zeros

    def mass(k):
        return (1 - low) ** k - (1 - high) ** k

    return (mass(n[None]) * mass(m[None])).sum(axis=0) / 2**MANTISSA


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, its 32 band keys (the registers themselves, four to a key); null if the set is empty."""

    def work(batches):
        for part in slices(batches, 1000):
            sets = shingle_sets(part.column("content"), width)
            digests = [digest_of(s) for s in sets]
            keys = [registers_of(s).view("<i8") if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content")).mapInArrow(
        work, "doc_id long, n_shingles long, digest binary, bands array<bigint>"
    )


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose corrected estimate is not clearly below the threshold."""

    def work(batches):
        for part in slices(batches, 4096):
            if not part.num_rows:
                continue
            left, right = (
                np.stack([x.values.to_numpy() for x in part.column(c)]).view("<u2").reshape(part.num_rows, -1) for c in ("ka", "kb")
            )
            chance = chance_agreement(part.column("na").to_numpy(), part.column("nb").to_numpy())
            estimate = ((left == right).mean(axis=1) - chance) / (1 - chance)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(
                pa.array(estimate >= percent / 100 - MARGIN)
            )

    one = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("bands").alias("ka"))
    two = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("bands").alias("kb"))
    sized = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.mapInArrow(work, "a long, b long")


def links_in_buckets(placed: DataFrame, open_: DataFrame, classes: DataFrame, percent: int, block: int = 2048, weight: int = 1_000_000) -> DataFrame:
    """Confirmed pairs (a, b) that tie together all components with linked members in one bucket.

    The members of a bucket's largest component meet all others, not each other, and the others meet one another too. Each
    of the two kinds is cut by hash into blocks of about `block` members and `weight` shingles. In each pair of blocks
    registers are compared first, and full sets where the estimate is not clearly below the threshold. Members tied
    already are not compared again, so a pair of blocks gives fewer links than it has members.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, comp, n, part = (table.column(c).to_numpy() for c in ("rep", "comp", "n_shingles", "part"))
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        registers = keys.view("<u2").reshape(len(rep), -1)
        sets = table.column("hashes").combine_chunks()
        flat, starts = sets.flatten().to_numpy(), np.concatenate(([0], np.cumsum(n)))
        band, comp = table.column("band")[0].as_py(), comp.copy()
        one, other = (np.flatnonzero(part == p) for p in (table.column("p")[0].as_py(), table.column("q")[0].as_py()))
        out = []
        for i in one.tolist():
            j = other[(comp[other] != comp[i]) & (100 * np.minimum(n[i], n[other]) >= percent * np.maximum(n[i], n[other]))]
            equal = (registers[i] == registers[j]).mean(axis=1)
            raw = equal >= percent / 100 - MARGIN  # the correction only lowers an estimate
            j, equal = j[raw], equal[raw]
            # a pair is looked at in the first band it shares
            first = (keys[i] == keys[j]).argmax(axis=1) == band
            j, equal = j[first], equal[first]
            if not len(j):
                continue
            chance = chance_agreement(np.full(len(j), n[i]), n[j])
            j = j[(equal - chance) / (1 - chance) >= percent / 100 - MARGIN]
            mine = flat[starts[i] : starts[i + 1]]
            for k in j.tolist():
                if comp[k] == comp[i]:
                    continue
                both = len(np.intersect1d(mine, flat[starts[k] : starts[k + 1]], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[k] - both):
                    out.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                    comp[comp == comp[k]] = comp[i]
        found = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    def cut(members: str, shingles: str):
        return F.greatest(F.ceil(F.col(members) / block), F.ceil(F.col(shingles) / weight)).cast("int")

    parts = open_.select("bucket", "major", cut("n_major", "w_major").alias("of_major"), cut("n_minor", "w_minor").alias("of_minor"))
    is_major = F.col("comp") == F.col("major")
    dealt = F.xxhash64(F.lit(9), "rep")
    own = F.when(is_major, F.pmod(dealt, "of_major")).otherwise(F.col("of_major") + F.pmod(dealt, "of_minor")).cast("int")
    far = F.sequence(F.when(is_major, F.col("of_major")).otherwise(0), F.col("of_major") + F.col("of_minor") - 1)
    rows = placed.drop("n_shingles").join(parts, "bucket").select("bucket", "band", "rep", "comp", own.alias("part"), F.explode(far).alias("far"))
    rows = rows.withColumn("p", F.least("part", "far")).withColumn("q", F.greatest("part", "far")).drop("far")
    rows = rows.join(classes.select("rep", "n_shingles", "bands", "hashes"), "rep")
    return rows.groupBy("bucket", "p", "q").applyInArrow(compare, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def work(batches):
        for part in slices(batches, 256):
            keep = []
            for x, y in zip(part.column("sa"), part.column("sb"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("hashes").alias("sb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text).

    `rounds` is the number of rounds with centres before all remaining pairs are compared; the result is the same.
    """
    marks = store(signatures(docs, width), "signatures")
    classes = store(
        marks.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes",
    )
    keyed = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key")).select(
        "rep", "n_shingles", "band", F.xxhash64("band", "key").alias("bucket")
    )
    shared = keyed.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket")
    active = store(keyed.join(shared, "bucket"), "buckets")
    some = not active.isEmpty()
    labels = store(active.select("rep", F.col("rep").alias("comp")).distinct(), "labels")

    def hashes(batches):
        for part in slices(batches, 1000):
            sets = [s.view(np.int64) for s in shingle_sets(part.column("content"), width)]
            digests = pa.array([digest_of(s) for s in sets], pa.binary())
            sets = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()), pa.array(np.concatenate(sets))
            )
            yield pa.RecordBatch.from_arrays([part.column("rep"), digests, sets], ["rep", "digest", "hashes"])

    sets = None
    for turn in range(rounds + 1) if some else ():
        last = turn == rounds
        placed = (active if turn or last else active.where(F.col("band") < FIRST_BANDS)).join(labels, "rep")
        if sets is None:
            # rows that share a doc_id can hold different sets, so the digest tells which is meant
            texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().alias("content"))
            found = texts.join(labels.select("rep"), "rep", "left_semi").mapInArrow(hashes, "rep long, digest binary, hashes array<bigint>")
            sets = store(found.join(classes, ["rep", "digest"]).dropDuplicates(["digest"]), "sets")
        if last:
            counts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
            open_ = counts.groupBy("bucket").agg(
                F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "comp")).alias("m")
            ).where("n > m.n").selectExpr(
                "bucket", "m.comp AS major", "m.n AS n_major", "m.w AS w_major", "n - m.n AS n_minor", "w - m.w AS w_minor"
            )
            links = links_in_buckets(placed, open_, sets, percent)
        else:
            order = F.struct(F.xxhash64(F.lit(turn), "rep") if turn else F.lit(0).alias("o"), "rep", "comp")
            centres = placed.groupBy("bucket").agg(F.min(order).alias("c")).select(
                "bucket", F.col("c.rep").alias("b"), F.col("c.comp").alias("cb")
            )
            pairs = placed.withColumnRenamed("rep", "a").join(centres, "bucket").where("comp <> cb")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            links = confirmed(plausible(pairs, sets, percent), sets, percent)
        ends = links.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        roots = connected_components(ends)
        labels = store(
            labels.join(roots.toDF("comp", "root"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp")), "labels"
        )
    groups = classes.select("digest", "rep").join(labels, "rep", "left").groupBy("digest").agg(
        F.min(F.coalesce("comp", "rep")).alias("comp")
    )
    out = marks.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
