"""The network's kernels: lanes in columns, exponentials with and without a shift, words looked up once for learning and scoring."""

import numpy as np
import pyarrow as pa
import pytest

from bazaarlens.llm import lm


def reference(w, states, targets):
    """Log probabilities in double precision, one token at a time."""
    w, out = {k: v.astype(np.float64) for k, v in w.items()}, []
    for h, symbol in zip(states.astype(np.float64), targets.tolist(), strict=True):
        group = int(lm.CLASS_OF[symbol])
        logits = h @ w["wc"] + w["bc"]
        found = logits[group] - np.logaddexp.reduce(logits)
        if group < lm.HEADS:
            inner = h @ w["wi"][group] + w["bi"][group]
            found += inner[symbol % lm.CLASS_SIZE] - np.logaddexp.reduce(inner)
        out.append(found)
    return np.array(out)


@pytest.mark.parametrize("spread", [0.3, 40.0])
def test_log_probabilities_equal_double_precision(spread):
    rng = np.random.default_rng(1)
    weights = {k: rng.normal(0, spread, s).astype(np.float32) for k, s in lm.SHAPES.items()}
    states = rng.uniform(-1, 1, (400, lm.HIDDEN)).astype(np.float32)
    targets = np.append(rng.integers(0, lm.SYMBOLS, 398), [0, lm.SYMBOLS - 1])
    out_weights = lm.outputs(weights)
    assert out_weights[2] == (spread < 1)
    found = lm.log_probabilities(out_weights, lm.with_one(states.T), targets)
    assert np.allclose(found, reference(weights, states, targets), rtol=1e-4, atol=1e-3 * spread)


def test_gradients_of_heads_and_shift():
    rng = np.random.default_rng(2)
    plain = {k: rng.normal(0, 0.3, s) for k, s in lm.SHAPES.items()}
    # the same distribution, but far logits
    far = {k: v.copy() for k, v in plain.items()}
    far["bc"] += 500
    far["bi"] -= 500
    targets = rng.integers(0, lm.SYMBOLS, (6, 40))
    targets[2, :5] = 0
    inputs = np.concatenate((np.zeros((1, 40), int), targets[:-1]))
    start = np.zeros((40, lm.HIDDEN))
    one, rows, _ = lm.gradients(plain, inputs, targets, start)
    two, _, _ = lm.gradients(far, inputs, targets, start)
    assert rows.tolist() == sorted(set(inputs.ravel().tolist()))
    assert lm.outputs(plain)[2] and not lm.outputs(far)[2]
    for key in one:
        assert np.allclose(one[key], two[key], atol=1e-9), key

    def loss(w):
        h, total = start, 0.0
        for t in range(6):
            h = lm.step(w, inputs[t], h * (inputs[t] != 0)[:, None])[0]
            total -= reference(w, h, targets[t]).sum()
        return total / targets.size

    head = int(targets[targets < lm.SHORT][0]) // lm.CLASS_SIZE
    for key, at in (("wi", (head, 3, 5)), ("bi", (head, 5)), ("u", (2, 50)), ("wc", (4, 7)), ("b", (30,))):
        moved = {k: v.copy() for k, v in plain.items()}
        moved[key][at] += 1e-5
        assert abs((loss(moved) - loss(plain)) / 1e-5 - one[key][at]) < 1e-4, key


def test_states_meet_the_output_in_any_number():
    rng = np.random.default_rng(3)
    weights = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in lm.SHAPES.items()}
    sizes = rng.integers(1, 90, 50)
    symbols = np.concatenate([np.append(rng.integers(1, lm.SYMBOLS, n - 1), 0) for n in sizes]).astype(np.int32)
    whole = lm.score_symbols(weights, symbols, sizes)
    assert np.allclose(whole, lm.score_symbols(weights, symbols, sizes, tile=7, together=5), rtol=1e-5)


def test_grams_of_a_slice():
    words = pa.array(["before", "", "a", "größe", "zz"], pa.large_string())
    keys, starts = lm.grams(words.slice(1))
    assert starts.tolist() == [0, 2, 5, 14] and keys.shape == (2, 18)
    assert (lm.grams(pa.array(["", "a", "größe", "zz"], pa.large_string()))[0] == keys).all()
    assert 0 <= keys.min() and keys.max() < lm.GRAM_BUCKETS


def test_words_are_looked_up_once(spark):
    rows = [(i, i % 3 == 0, f"word{i % 5} the word{i} the" if i else "") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, content string")
    vocabulary, _ = lm.fit_vocabulary(docs.where("NOT held_out").select("doc_id", "content"), 12)
    encoded = lm.encode_rows(docs, vocabulary)
    got = {r["doc_id"]: r for r in encoded.collect()}
    assert len(got) == 40 and len({r["key"] for r in got.values()}) == 40
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 and 0 not in r["ids"][:-1] for r in got.values())
    # rare words and known ones make up the text
    assert all(r["n_known"] - 1 + sum(r["times"]) == r["n_tokens"] - 1 for r in got.values())
    met = {i for r in got.values() if not r["held_out"] for i in r["ids"]}
    start = lm.new_weights(vocabulary)["x"]
    for learned in (lm.learn_rows(encoded, vocabulary), lm.fit_network(docs.where("NOT held_out").select("doc_id", "content"), vocabulary)):
        # averaging rounds the others
        moved = set(np.flatnonzero((abs(learned["x"] - start) > 1e-4).any(axis=1)).tolist())
        assert {0} <= moved <= met


def test_lanes_hold_every_text_once():
    sizes = np.array([3, 9, 1, 4, 4, 0, 7])
    texts, of_lane, loads = lm.deal_lanes(sizes, 3)
    assert sorted(texts.tolist()) == [0, 1, 2, 3, 4, 6] and of_lane.sum() == 6
    assert loads.tolist() == sorted((sizes[x].sum() for x in np.split(texts, np.cumsum(of_lane)[:-1])), reverse=True)
    assert loads.max() - loads.min() <= 2
    rng = np.random.default_rng(4)
    weights = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in lm.SHAPES.items()}
    symbols = [np.append(rng.integers(1, lm.SYMBOLS, max(n - 1, 0)), 0)[:n].astype(np.int32) for n in sizes]
    # a text's score does not depend on those before it in its lane
    alone = [lm.score_symbols(weights, s, np.array([len(s)]))[0] for s in symbols]
    assert np.allclose(lm.score_symbols(weights, np.concatenate(symbols), sizes, tile=3), alone, rtol=1e-5) and alone[5] == 0


def test_words_are_found_by_their_bytes():
    listed = pa.array(["the", "größe", "a"], pa.large_string())
    none = np.zeros(0)
    table = np.random.default_rng(5).normal(size=(lm.GRAM_BUCKETS, lm.TAILS)).astype(np.float32)
    vocabulary = lm.Vocabulary(listed, np.array([9, 5, 5]), lm.tail_class(listed, table), table, 1, 20, 4, none, none)
    words = pa.array(["x", "a", "größe", "grosse", "the"], pa.large_string())
    for some in (words, words.slice(1)):
        symbols, counts, found = vocabulary.look_up(some)
        assert counts.tolist()[-4:] == [5, 5, 0, 9] and found.tolist()[-4:] == [True, True, False, True]
        assert symbols.tolist()[-4:-2] == [3, 2] and symbols[-1] == 1 and symbols[-2] >= lm.SHORT
