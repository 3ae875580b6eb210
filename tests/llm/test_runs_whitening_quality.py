"""Periodic runs and whitening against brute force, the attention model by differences and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import quality, queries, runs, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- runs ---------------------------------------------------------------------------------------------------------

def brute_runs(words, least=12):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q):
                if not any(all(words[k] == words[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                    found.add((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def run_texts():
    rng = np.random.default_rng(4)
    texts = [None, "", " \t\n", "x", "a " * 12, "a b " * 5 + "a", "a b " * 6, "ab\x1cab " * 20, "Ä ö ü " * 9, "the THE The " * 400]
    for _ in range(150):
        n, letters = int(rng.integers(1, 80)), int(rng.integers(1, 7))
        words = [f"w{k}" for k in rng.integers(0, letters, n)]
        a, p = int(rng.integers(0, n)), int(rng.integers(1, 20))
        texts.append("  ".join(words[i if i < a else a + (i - a) % p if a + (i - a) % p < n else i] for i in range(n)))
    return texts + texts[10:14]


def test_runs_equal_brute_force(spark):
    rows = [(i, t, 1, "r") for i, t in enumerate(run_texts())] + [(None, "b c " * 9, 1, None), (3, "z " * 30, 2, "r"), (3, "z " * 30, 2, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = runs.digests(runs.periodic_runs(runs.with_planted_periods(docs))).collect()
    assert Counter(map(tuple, got)) == Counter(brute_row(i, t) for i, t, *_ in rows)
    assert got and runs.digests(runs.periodic_runs(docs.limit(0))).count() == 0


def test_registered_runs_equal_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in queries.op11_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(WORD.findall(r.text or "")) < 400]
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[r.doc_id] == brute_row(r.doc_id, r.text) for r in short)


def test_transform_is_exact_and_inverts():
    rng = np.random.default_rng(0)
    x = rng.integers(0, runs.PRIME, (64, 5))
    assert (runs.inverse(runs.transform(x.copy())) == x).all()
    text, block = rng.integers(0, 2, 400), 8
    starts = np.arange(0, 320, 8)
    s, d = runs.occurrences(text, starts, block, 16, 16, np.full(len(starts), 400))
    want = {(a, k) for a in starts for k in range(16, 32) if a + k + block <= 400 and (text[a : a + block] == text[a + k : a + k + block]).all()}
    assert want <= set(zip(s.tolist(), d.tolist(), strict=True)) and want


@pytest.mark.parametrize("period", [40_000, 90_000])
def test_long_periods_of_a_very_long_text(period):
    words = np.random.default_rng(1).integers(0, 50_000, 300_000)
    place = np.arange(len(words))
    words = words[np.where(place < 77, place, 77 + (place - 77) % period)]
    start, end, q = runs.find_runs(words, np.array([len(words)]))
    assert (start.tolist(), end.tolist(), q.tolist()) == ([77], [300_000], [period])


def test_one_word_throughout_a_long_text():
    start, end, q = runs.find_runs(np.zeros(50_000, np.int64), np.array([20_000, 30_000]))
    assert (start.tolist(), end.tolist(), q.tolist()) == ([0, 20_000], [20_000, 50_000], [1, 1])


# ---- whitening ----------------------------------------------------------------------------------------------------

def brute_whitening(rows, components=16):
    valid = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in valid})
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = {}
    for key, x in valid:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        projected = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ directions[:, order] / np.sqrt(values[order])
        out.setdefault(key, []).append((n, deviation, projected, values[order] / values.sum()))
    return out


def check_whitening(got, want):
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, []).append(r)
    assert rows.keys() == want.keys()
    width = len(next(iter(want.values()))[0][2])
    sign = None
    for key, expected in want.items():
        found = {c: sorted((r for r in rows[key] if r.component == c), key=lambda r: r.deviation) for c in range(1, width + 1)}
        expected = sorted(expected, key=lambda e: e[1])
        assert len(rows[key]) == width * len(expected) and all(len(f) == len(expected) for f in found.values())
        for at, (n, deviation, projected, explained) in enumerate(expected):
            own = [found[c][at] for c in range(1, width + 1)]
            assert all(r.n == n and int(r.deviation) == deviation and r.identity_error < 1e-8 for r in own)
            values = np.array([r.whitened for r in own])
            if sign is None and np.abs(projected).min() > 1e-3:
                sign = np.sign(values / projected)
            assert np.allclose(np.abs(values), np.abs(projected), atol=1e-7) and np.allclose([r.explained for r in own], explained, rtol=1e-9)
            assert sign is None or np.allclose(values, sign * projected, atol=1e-7)


def test_whitening_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    stretch = np.array([9.0, 5.0, 3.0, 2.0, 1.0])
    rows = [(i, (rng.normal(size=5) * stretch).tolist()) for i in range(300)]
    rows += [(900, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (901, None), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5)]
    rows += [(904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, []), *((1000 + i, rows[7][1]) for i in range(200))]
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<double>, x int, place int").repartition(5)
    got = whitening.whiten(table, components=3).collect()
    check_whitening(got, brute_whitening(rows, 3))
    # many small blocks, cut along the inner dimension
    monkeypatch.setattr(whitening.np, "clip", lambda value, low, high: 16)
    check_whitening(whitening.whiten(table).collect(), brute_whitening(rows))


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [None])], schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [7.0])], schema)).collect()
    assert [(r.vec_id, r.component) for r in sorted(flat)] == [(1, 1), (2, 1)]
    assert sorted(round(abs(r.whitened), 9) for r in flat) == [1, 1] and flat[0].explained == 1


def test_registered_whitening_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check_whitening(queries.op12_whitening(spark, folder).collect(), brute_whitening(rows))


# ---- quality ------------------------------------------------------------------------------------------------------

def test_attention_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, sizes, goal = rng.normal(size=(9, quality.FEATURES)), np.array([2, 3, 4]), np.array([0.0, 1.0, 0.5])
    model = quality.learn_attention(x, sizes, goal, epochs=2)
    exact = model.gradients(x, sizes, goal)

    def loss():
        s = model.forward(x, sizes)[0]
        return -(goal * np.log(s) + (1 - goal) * np.log(1 - s)).mean()

    for name, w in model.weights.items():
        place = tuple(rng.integers(0, d) for d in w.shape)
        kept = w[place]
        w[place] = kept + 1e-5
        above = loss()
        w[place] = kept - 1e-5
        below = loss()
        w[place] = kept
        assert (above - below) / 2e-5 == pytest.approx(exact[name][place], abs=1e-8)


def test_attention_of_a_text_is_a_distribution_and_scores_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["good words here " * 100, "", None, "junk&&& " * 70 + "fine words " * 200, "x"]
    x, sizes = quality.passages(pa.array(texts))
    assert sizes.tolist() == [5, 1, 1, 8, 1] and np.isfinite(x).all()
    model = quality.learn_attention(x, sizes, np.array([1.0, 1, 1, 0, 1]), epochs=4)
    score, attention = model.score(x, sizes)
    assert np.allclose(np.add.reduceat(attention, np.cumsum(sizes) - sizes), 1)
    for i, text in enumerate(texts):
        own, n = quality.passages(pa.array([text], pa.string()))
        assert np.isclose(model.score(own, n)[0][0], score[i], atol=1e-5)


def test_quality_separates_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op13_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert len(found) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.top_passage < r.n_passages for i, r in found.items())
    held = [(labels[i], r.predicted) for i, r in found.items() if r.held_out and i in labels]
    good, bad = [p for y, p in held if y], [1 - p for y, p in held if not y]
    assert len(bad) >= 5 and sum(good) >= 0.95 * len(good) and sum(bad) >= 0.75 * len(bad)


def test_quality_of_awkward_tables(spark):
    schema = "doc_id long, text string, score int, label int"
    rows = [(1, "fine text", 1, 1), (1, "fine text", 1, 1), (None, "fine text", 1, 1), (2, None, 1, 1), (3, "", 1, 1), (4, "y " * 50_000, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (4, None), (9, 1)], "doc_id long, label int")
    model = quality.learn_quality(docs, marks)
    found = quality.score_quality(docs, model).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (2, 3)}) == 1  # a null text is an empty one
    alone = quality.learn_quality(docs, marks.where("label = 1 AND doc_id = 2"))
    assert {r.score for r in quality.score_quality(docs, alone).collect()} == {1.0}
    nothing = quality.learn_quality(docs.limit(0), marks)
    assert {r.score for r in quality.score_quality(docs, nothing).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded_by_distinct_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 50} " * 30) for i in range(600)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(quality, "learn_attention", lambda x, sizes, goal: seen.append((sizes.tolist(), goal.tolist())))
    quality.learn_quality(docs, marks, max_texts=20, max_passages=1)
    assert seen[0][0] == [1] * 20 and set(seen[0][1]) <= {0.0, 1.0}
