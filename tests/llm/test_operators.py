"""Each operator against a brute-force version or an exact round trip, on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bazaarlens.llm import ann, chat, decontaminate, langid, line_dedup, lm, near_dedup, packing, token_counts, toxicity
from bazaarlens.llm.components import connected_components

SCHEMA = "doc_id long, text string, score int, rep string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(n, seed, low=5, high=60, vocabulary=400):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(stems, rng.integers(low, high))) for _ in range(n)]


AWKWARD = [None, "", " ", "x", "ÀÉ ü z", "a  b\t c\n\n d\x1ce", "<|endoftext|> Foo<|endoftext|>BAR", "The the THE " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    texts = AWKWARD + random_texts(60, 1)
    texts += [texts[20], texts[20], texts[21] + " tail"]
    rows = [(i, t, 1, "r", 2) for i, t in enumerate(texts)] + [(None, texts[22], 1, None, 2), (3, "x", 1, "r", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_match_the_library_and_fill_the_cache(spark, docs, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    first = token_counts.count_tokens(docs, path, cache).collect()
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    expected = Counter()
    for (doc, text), n in texts.items():
        ids = len(library.encode(text, add_special_tokens=False).ids)
        expected[doc, len(text.encode()), ids, ids > 512] += n
    assert Counter(tuple(r) for r in first) == expected
    stored = spark.read.parquet(cache).count()
    assert stored == len({t for _, t in texts})
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, path, cache).collect()) == expected
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded twice
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_a_control_character_after_a_blank_is_counted():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_counts.make_counter(path)
    texts = ["abc y", "x \0abc", "x\n\0abc", "\0abc", "abc x", "\0", "x \0"]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing_covers_every_id_once(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    limits = packing.Limits(tokens=128, segments=6, loss_tokens=100)
    pieces = packing.pack_sequences(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, limits).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for row in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        ids = np.array(library.encode(row.text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(by_doc[row.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 128 and len(parts) <= 6 and sum(p.loss_tokens for p in parts) <= 100
    assert packing.pack_sequences(empty(spark), path).count() == 0
    prompted = packing.pack_sequences(docs.where("doc_id = 30"), path, packing.Limits(), prompt="text").collect()
    assert sum(p.length for p in prompted) > sum(p.loss_tokens for p in prompted) > 0


def test_chat_reads_back_what_was_written(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "<<SYS>>[\\INST]"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "tool[TEXT]", "[/ROLE]"),
            (2, 0, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "a\\"), (None, 0, "user", "x"), (2, 1, "assistant", "a\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(turns.where("conv_id = 9"))).count() == 0


def test_chat_leaves_no_bare_control_string_in_a_field():
    import re as r

    controls = r.compile("|".join(map(r.escape, chat.CONTROLS)))
    for role in ("user", "assistant", "system", "tool", "[TEXT]"):
        for text in ("</s>", "<<SYS>>evil<</SYS>>", "[/INST]", "plain", "a\\", "[\\INST]", "<s><s>", ""):
            block, begin, end, escaped = chat.format_turn(role, text)
            assert not controls.search(block[begin:end]) and chat.unescape(block[begin:end]) == text
            assert chat.parse(block) == (role, text, len(block)) and escaped == (block[begin:end] != text or role == "[TEXT]")
    reader = chat.Reader(1)
    reader.add("[INST]a[/IN", None, None)  # one text, wherever it is cut
    reader.add("ST]<s>b</s>", 3, 4)
    assert reader.row()[1] == 2
    reader.add("[INST]never closed", None, None)
    with pytest.raises(ValueError, match="grammar"):
        reader.row()


def exact_components(rows, width, percent):
    sets = {}
    for doc, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_equal_all_pairs(spark, docs):
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    base = random_texts(1, 9, 150, 151)[0].split()
    for i in range(40):  # a group in which many, but not all, pairs are linked
        words = list(base)
        for at in rng.choice(len(words), rng.integers(1, 6), replace=False):
            words[at] = f"new{i}x{at}"
        rows.append((1000 + i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table, width=4).collect()}
    assert got == exact_components(rows, 4, 80)
    both = near_dedup.near_duplicates(docs).where("doc_id IS NULL").collect()
    assert [(r.component_id, r.kept) for r in both] == [(22, False)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    same = np.mean(near_dedup.registers_of(x[:3000]) == near_dedup.registers_of(x[1000:]))
    chance = near_dedup.chance_agreement(np.array([3000]), np.array([3000]))[0]
    assert abs((same - chance) / (1 - chance) - 0.5) < 0.15 and 0 < chance < 2e-3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}


def test_lines_of_recurring_templates_go(spark):
    own = random_texts(12, 5, 8, 20)
    passage = "this very long passage stands in many documents and says nothing of its own"
    rows = [(i, f"{t}\n{passage}\nPage {i} of the yearly edition as printed here") for i, t in enumerate(own)]
    rows += [(50, rows[0][1]), (60, None), (61, ""), (62, "Only here"), (62, "Only here")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS places", "2 AS line")
    got = {r.row.doc_id: r for r in line_dedup.drop_recurring_lines(table).collect()}
    assert got[0].text == rows[0][1] and got[50].text == rows[0][1]  # the first document and its copy
    assert all(got[i].text == own[i] and got[i].n_dropped == 2 for i in range(1, 12))
    assert (got[60].text, got[61].text, got[62].text) == (None, "", "Only here")
    assert line_dedup.drop_recurring_lines(empty(spark)).count() == 0


def test_long_lines_of_two_texts_go(spark):
    own = random_texts(4, 15, 8, 20)
    passage, short = (" ".join(f"{w}s" for w in random_texts(1, 16, n, n + 1)[0].split()) for n in (60, 20))
    rows = [(0, f"{own[0]}\n{passage}\n{short}"), (1, f"{own[1]}\n{short}\n{passage}"), (2, own[2]), (3, f"{own[3]}\n12 May 2021")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in line_dedup.drop_recurring_lines(table).collect()}
    assert got == {**dict(rows), 1: f"{own[1]}\n{short}"}
    same = line_dedup.drop_recurring_lines(table, long_tokens=None).collect()
    assert {r.row.doc_id: r.text for r in same} == dict(rows)


def test_lines_with_dates_and_page_numbers_go(spark):
    own = random_texts(5, 17, 8, 20)
    lines = ["Copyright {y} Acme Inc.", "Page {i} of {y}", "Posted {i} May {y} by admin", "12 May 2021", "10 20 30"]
    rows = [(i, "\n".join([t, *(x.format(i=i, y=2020 + i) for x in lines), f"alone {i} {i} {i}"])) for i, t in enumerate(own)]
    rows += [(10 + i, f"It is a {t}") for i, t in enumerate("red cat here,blue dog there,green fox anywhere".split(","))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in line_dedup.drop_recurring_lines(table).collect()}
    assert got == {i: t if i in (0, 10, 11, 12) else f"{own[i]}\nalone {i} {i} {i}" for i, t in rows}


@pytest.mark.parametrize("most_bits", [1 << 15, 1 << 20])
def test_lines_are_let_go_before_they_are_dealt(spark, most_bits):
    from pyspark.sql import functions as F

    hashed = spark.range(20_000).select("id", F.xxhash64("id").alias("leaf"))
    keys = hashed.where("id % 40 = 0").select("leaf").unionByName(spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), (0,)], "leaf long"))
    rows = hashed.unionByName(keys.select(F.lit(-1).cast("long").alias("id"), "leaf"))
    kept = line_dedup.likely_in(rows, keys, "leaf", most_bits)
    assert kept.join(keys, "leaf", "left_semi").count() == rows.join(keys, "leaf", "left_semi").count()
    assert kept.join(keys, "leaf", "left_anti").count() < 2_500
    assert line_dedup.likely_in(rows, keys.limit(0), "leaf").count() == 0


def test_leaks_equal_exact_containment(spark):
    items = [(i, t) for i, t in enumerate(random_texts(20, 6, 6, 40))] + [(50, "Tiny item"), (51, None), (52, "...")]
    fill = random_texts(30, 7, 100, 900)
    rows = [(i, f"{t} {items[i % 20][1].upper()}, {t}" if i % 2 else t) for i, t in enumerate(fill)]
    rows += [(90, "say: TINY, item!"), (91, None), (92, ""), (None, items[0][1])]
    half = items[3][1].split()
    rows.append((93, " ".join(half[: len(half) // 2]) + " " + fill[0]))
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS w", "'x' AS h")

    def sets(text, k=5):
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        k = min(k, len(words))
        return k, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    expected = set()
    for item, text in items:
        k, wanted = sets(text)
        for doc, body in rows:
            words = [w for w in re.split(r"[\W_]+", (body or "").lower()) if w]
            held = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
            if doc is not None and wanted and 100 * len(wanted & held) >= 80 * len(wanted):
                expected.add((doc, item, len(wanted & held), len(wanted)))
    got = decontaminate.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got} == expected and len(expected) >= 16
    assert decontaminate.contaminated(table, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_nearest_reaches_the_exact_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    vectors[300:400] = vectors[300]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0]), (2200, [None] * 16), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, depth=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    found = 0
    for q in range(0, 900, 50):
        score = np.round(unit @ unit[q], 9)
        score[q] = -9
        best = np.lexsort((np.arange(900), -score))[:5]
        found += len(set(best.tolist()) & {v for v, _ in got[q]})
        assert all(abs(score[v] - s) < 1e-6 for v, s in got[q])
    assert set(got) == set(range(0, 900, 50)) and found >= 0.9 * 90
    assert [v for v, _ in got[300]] == [301, 302, 303, 304, 305]
    assert ann.nearest(table.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n", [2, 4, 6, 50, 200])
def test_small_tables_are_searched_whole(spark, n):
    from pyspark.sql import functions as F

    vectors = np.random.default_rng(n).normal(size=(n, 64))
    table = spark.createDataFrame([(50 * i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(n):
        score = unit @ unit[q]
        score[q] = -9
        assert got[50 * q] == [50 * int(x) for x in np.argsort(-score)[: min(5, n - 1)]]


def test_proportional_vectors_tie(spark):
    """Forty multiples of the query by powers of two have exactly its cosine: the smallest ids rank."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    rows = [(50, base.tolist(), 1)] + [(10_039 - i, (base * 2.0 ** (i % 9 - 4)).tolist(), 1) for i in range(40)]
    rows += [(20_001 + i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(300, 32)))]
    # distinct directions of one exact cosine
    flat = np.zeros(32)
    flat[0] = 1.0
    rows += [(100, flat.tolist(), 1)]
    for i in range(31):
        v = np.zeros(32)
        v[0], v[1 + i] = 4.0, 3.0
        rows.append((30_031 - i, v.tolist(), 1))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id").isin(50, 100)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert [v for v, _ in got[50]] == list(range(10_000, 10_005)) and all(s == pytest.approx(1.0) for _, s in got[50])
    assert [v for v, _ in got[100]] == list(range(30_001, 30_006)) and {s for _, s in got[100]} == {0.8}


def test_blocks_do_not_follow_the_ids():
    sizes = np.bincount(ann.block_of(np.arange(0, 500_000, 50), 10), minlength=10)
    assert sizes.min() > 800


def test_more_languages_than_dimensions(spark):
    rng = np.random.default_rng(0)
    stems = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(6)] for k in range(20)}
    rows = [(" ".join(rng.choice(words, 12)), lang) for lang, words in stems.items() for _ in range(40)]
    table = spark.createDataFrame(rows, "text string, lang string")
    model = langid.learn_languages(table, max_texts=500)
    assert len(model.labels) == 20 and model.out is not None
    docs = spark.createDataFrame([(i, " ".join(rng.choice(stems[f"l{i % 20:02d}"], 12))) for i in range(100)], "doc_id long, text string")
    found = langid.identify(docs, model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 20:02d}" for r in found) >= 95


def test_language_on_held_out_rows(spark):
    parts = {"aa": "ka ri to mo sa".split(), "bb": "sch ung ein lich ver".split(), "cc": "eau oux ion ment que".split()}
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(rng.integers(3, 30))), lang))
    table = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 34 !", None)], "doc_id long, text string, lang string")
    model = langid.learn_languages(table.where("doc_id % 5 <> 0"), buckets=1 << 12)
    got = {r.doc_id: r for r in langid.identify(table, model).collect()}
    right = np.mean([got[i].lang_pred == lang for i, _, lang in rows if i % 5 == 0])
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und" and not got[900].accepted
    nothing = langid.learn_languages(table.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.identify(table, nothing).collect()} == {"und"}


def test_copies_of_few_texts_are_a_language_too(spark):
    rows = [(f"word{i} ein und der {i}", "many") for i in range(60)]
    few = {f"l{k}": f"{x * 3} {x * 2} {x}{x} {x * 4}" for k, x in enumerate("qwzxkv")}
    rows += [(text, lang) for lang, text in few.items() for _ in range(2000)]
    table = spark.createDataFrame(rows, "text string, lang string")
    model = langid.learn_languages(table, rows_per_language=20, buckets=1 << 12)
    assert model.labels == sorted(["many", *few])
    asked = spark.createDataFrame(list(few.items()), "doc_id string, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()} == {lang: lang for lang in few}


def test_toxicity_separates_held_out_rows(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = []
    for i, text in enumerate(random_texts(500, 11, 20, 60)):
        words = text.split()
        if i % 5 == 0:
            for bad in rng.choice(["blarg", "zonkish", "zonkado", "quixel"], 3):
                words.insert(int(rng.integers(len(words))), str(bad))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn_toxicity(table.where("doc_id % 3 <> 1").select("text", "toxic"))
    test = table.unionByName(spark.createDataFrame([(901, None, 0), (902, "", 0)], table.schema))
    got = test.select("doc_id", "toxic", toxicity.toxicity_score(spark, model)(F.col("text")).alias("s")).collect()
    held = [r for r in got if r.doc_id % 3 == 1 and r.doc_id < 900]
    assert np.mean([(r.s >= 0.7) == r.toxic for r in held]) > 0.95 and all(0 <= r.s <= 1 for r in got)
    knots, values = toxicity.fit_isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(values) >= 0).all() and len(knots) == len(values)
    assert toxicity.learn_toxicity(table.where("doc_id < 0").select("text", "toxic")).share == 0.0


def test_scores_beat_the_baseline_and_count_exactly(spark, docs):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    chains = [["alpha", "beta", "gamma", "delta."], ["eins", "zwei", "drei", "vier."]]
    rows = [(i, " ".join(chains[i % 2] * int(rng.integers(20, 60)))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    got = lm.score_documents(table, held).collect()
    words = {(r.doc_id, r.text): WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) for r in table.collect()}
    count, texts = Counter(), 0
    for r in table.collect():
        if r.doc_id is None or r.doc_id % 7 != 2:
            count.update(words[r.doc_id, r.text])
            texts += 1
    total, distinct = sum(count.values()) + texts, len(count) + 1
    expected = Counter()
    for r in table.collect():
        own = words[r.doc_id, r.text]
        base = sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in own) + np.log10((texts + 1) / (total + distinct + 1))
        expected[r.doc_id, len(own) + 1, sum(w in count for w in own) + 1, round(base, 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == expected
    assert {r.train_tokens for r in got} == {total}
    chain = lm.score_documents(table.where("doc_id < 300 AND text LIKE '%. %'"), held, share=2).where("held_out").collect()
    assert len(chain) > 30 and sum(r.score for r in chain) > sum(r.base_score for r in chain)
    assert lm.score_documents(empty(spark), held).count() == 0


def test_side_by_side_scores_equal_token_by_token():
    """Lanes, windows and tiles against one plain pass per text."""
    rng = np.random.default_rng(3)
    weights = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in lm.SHAPES.items()}
    sizes = np.concatenate((rng.integers(1, 70, 40), [1, 1, 333]))
    texts = [np.append(rng.integers(1, lm.SYMBOLS, n - 1), 0).astype(np.int32) for n in sizes]
    found = lm.score_symbols(weights, np.concatenate(texts), sizes, tile=16)
    for text, score in zip(texts, found, strict=True):
        h, total, before = np.zeros((1, lm.HIDDEN), np.float32), 0.0, 0
        for symbol in text:
            h = lm.step(weights, np.array([before]), h)[0]
            total += lm.log_likelihood(weights, h, np.array([symbol]))[0]
            before = symbol
        assert abs(total - score) < 1e-3 * max(1, abs(total))


def test_every_training_text_reaches_the_network(spark):
    rows = [(i, " ".join(f"w{i}x{j % 5}" for j in range(23))) for i in range(12)]
    texts = spark.createDataFrame(rows, "doc_id long, content string")
    vocabulary, _ = lm.fit_vocabulary(texts, 1000)
    moved = np.flatnonzero((lm.fit_network(texts, vocabulary)["x"] != lm.new_weights(vocabulary)["x"]).any(axis=1))
    assert set(range(61)) <= set(moved.tolist())  # the end and the five words of each text
    start = lm.new_weights(vocabulary)
    for n in (1, 2, 3):  # fewer symbols than lanes
        learned = lm.train({k: v.copy() for k, v in start.items()}, np.arange(1, n + 1), 0.01)
        assert set(range(n)) <= set(np.flatnonzero((learned["x"] != start["x"]).any(axis=1)).tolist())


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    weights = {k: rng.normal(0, 0.3, s) for k, s in lm.SHAPES.items()}
    targets = rng.integers(0, lm.SYMBOLS, (5, 3))
    inputs = np.concatenate((np.zeros((1, 3), int), targets[:-1]))
    found, rows, _ = lm.gradients(weights, inputs, targets, np.zeros((3, lm.HIDDEN), np.float32))

    def loss():
        h, total = np.zeros((3, lm.HIDDEN)), 0.0
        for t in range(5):
            h = lm.step(weights, inputs[t], h * (inputs[t] != 0)[:, None])[0]
            total -= lm.log_likelihood(weights, h, targets[t]).sum()
        return total / targets.size

    at_row = int(np.flatnonzero(rows == inputs[2, 1])[0])
    whole = np.zeros(lm.SHAPES["x"])
    whole[rows] = found["x"]
    found["x"] = whole
    for key in ("u", "b", "wc", "bc", "x"):
        at = (int(rows[at_row]), 3) if key == "x" else tuple(0 for _ in lm.SHAPES[key])
        kept = weights[key][at]
        weights[key][at] = kept + 1e-4
        up = loss()
        weights[key][at] = kept - 1e-4
        down = loss()
        weights[key][at] = kept
        assert abs((up - down) / 2e-4 - found[key][at]) < 1e-3
