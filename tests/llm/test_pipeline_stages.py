"""Each stage of the corpus pipeline against brute force, on a table with repeated rows, shared ids, nulls and clashing columns."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bazaarlens.llm import toxicity

SCHEMA = "doc_id long, text string, place int, row string, n int, digest string"
ITEMS = ["what is the capital of the small island in the north sea", "seven sailors sold silver shells"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 8))) for _ in range(900)]
    return [" ".join(rng.choice(stems, rng.integers(30, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def rows():
    base = texts(40, 5)
    near = base[3] + " extra tail"
    plain = [
        (1, base[0]), (5, base[0]), (5, base[1]), (7, base[2]), (7, base[2]),  # unlike texts under one id, a repeated row
        (None, base[3]), (9, near), (None, base[4]), (None, base[4]), (11, None), (12, None), (13, ""), (14, "short"), (15, "short"),
        (20, base[5] + " " + ITEMS[0]), (20, base[6]), (None, ITEMS[1] + " " + base[7]),
    ]
    return [(i, t, 1, "r", 2, "d") for i, t in plain + [(100 + k, t) for k, t in enumerate(base[8:])]]


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(rows):
    of = [sets(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if of[i] and of[j] and 100 * len(of[i] & of[j]) >= 80 * len(of[i] | of[j]):
            old, new = label[i], label[j]
            label = [new if k == old else k for k in label]
    groups = {}
    for i, k in enumerate(label):
        groups.setdefault(k, []).append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def brute_clean(rows):
    def holds(text, item):
        words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        wanted = item.split()
        k = min(5, len(wanted))
        own = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        need = {tuple(wanted[i : i + k]) for i in range(len(wanted) - k + 1)}
        return 100 * len(own & need) >= 80 * len(need)

    return [r for r in rows if not any(holds(r[1], item) for item in ITEMS)]


def test_near_stage_decides_by_row(spark, folder, rows):
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), folder)
    assert got.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert Counter(map(tuple, got.collect())) == Counter(brute_near(rows))


def test_leak_stage_decides_by_row(spark, folder, rows):
    got = corpus_pipeline.leak_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), folder)
    assert got.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert Counter(map(tuple, got.collect())) == Counter(brute_clean(rows))


def test_line_stage_keeps_rows_without_recurring_lines(spark, folder, rows):
    footer = "all rights of this page are reserved by the owner"
    marked = [(200 + i, f"{t}\n{footer}", 1, "r", 2, "d") for i, t in enumerate(texts(5, 9))]
    got = corpus_pipeline.line_stage(spark, spark.createDataFrame(rows + marked, SCHEMA).repartition(4), folder)
    kept = {r.doc_id: r.text for r in got.where("doc_id >= 200").collect()}
    assert len(kept) == 5 and sum(footer in t for t in kept.values()) == 1  # the first document keeps it
    assert Counter(map(tuple, got.where("doc_id < 200 OR doc_id IS NULL").collect())) == Counter(rows)


def test_toxicity_stage_follows_the_score(spark, rows, tmp_path):
    foul = [(300 + i, f"you {w} idiot you total {w}!!! SHUT UP you {w} {t[:40]}", 1, "r", 2, "d")
            for i, (w, t) in enumerate(zip(["blarg", "frump", "gonk"] * 30, texts(90, 12)))]
    docs = spark.createDataFrame(rows + foul, SCHEMA).repartition(4)
    labels = [(r[0], 0, 0) for r in rows if r[0] and r[0] >= 100] + [(r[0], 1, 1) for r in foul] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(map(tuple, corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).collect()))
    model = toxicity.learn_toxicity(corpus_pipeline.labelled_texts(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    scores = docs.select("*", toxicity.toxicity_score(spark, model)(docs.text).alias("s")).collect()
    assert got == Counter(tuple(r)[:-1] for r in scores if r.s < corpus_pipeline.REJECT)
    assert sum(got[r] for r in foul) < 10 and all(got[r] for r in rows if r[0] and r[0] >= 100)


def test_packing_stage_covers_every_id(spark, folder, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.packing_stage(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    want = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r.length for r in got) == want and {r.doc_id for r in got} == {r[0] for r in rows}


def test_stages_take_an_empty_table(spark, folder, rows, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path) if name == "toxicity" else folder).count() == 0, name


def test_only_hashes_of_texts_meet_the_labels(spark):
    """Copies, shared and null ids, null texts: each text once, by the majority of its labelled rows."""
    docs = [(1, "a"), (2, "a"), (3, "a"), (4, "b"), (4, "c"), (None, "d"), (5, None), (6, ""), (7, "e"), (8, "never labelled")]
    labels = [(1, 1), (2, 1), (3, 0), (4, 1), (4, 0), (None, 1), (5, 1), (6, 0), (7, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = corpus_pipeline.labelled_texts(docs, labels)
    learned = {k for k in range(1, 9) if zlib.crc32(str(k).encode()) % 3 != 1}
    of = {1: ("a", 1), 2: ("a", 1), 3: ("a", 0), 5: ("", 1), 6: ("", 0)}
    votes = {}
    for k in learned & of.keys():
        votes.setdefault(of[k][0], []).append(of[k][1])
    expected = {t: int(2 * sum(v) >= len(v)) for t, v in votes.items()} | ({"b": 1, "c": 1} if 4 in learned else {})
    assert sorted((r.content, r.toxic) for r in found.select("content", "toxic").collect()) == sorted(expected.items())
    smallest = toxicity.sample_texts(found.select("pick", "toxic"), docs, 2)
    assert {r.pick for r in smallest.collect()} == set(sorted(r.pick for r in found.collect())[:2])
