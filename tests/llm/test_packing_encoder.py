"""The encoder of packing against the library on whole texts, and the bounded memory behind it."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from bazaarlens.llm import packing
from bazaarlens.llm import common
from bazaarlens.llm.common import Memory, load_tokenizer

AWKWARD = [
    "", " ", "\n", "\n \n", "a", "Word word. WORD!? word.,;:!?", "...", "?! .a a. .a.", "Größe GRÖSSE größe, ÀÉÎ àéî. ªº µ Straße!",
    "Ünï.  cödé\n\n×÷ × a×b naïve;", "日本語 テキスト。 ok", "слово Слово, СЛОВО!", "tab\there a", "line\r\nend x", "nul\0nul b", "soft­hyphen c",
    "zero​width d", "no break e", "  f", "x1 1x 3.14 v2.0, a_b a-b don't DON'T", "İstanbul ıI ǅ ŉ", "é é. é", "| a | b |",
    "[CLS] </w> <unk> a</w> word</w>", "a" * 300 + ". " + "Ab" * 200, "😀 smile😀. 😀",
]


@pytest.mark.parametrize("memory", [72_000_000, 2_000])
def test_ids_equal_the_library(monkeypatch, memory):
    monkeypatch.setattr(packing, "MEMORY", memory)
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(4)
    parts = [w for text in AWKWARD for w in text.split(" ")]
    texts = AWKWARD + [rng.choice(" \n").join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(200)]
    ids_of, plain = packing.make_encoder(path, 2), load_tokenizer(path)
    want = [[*plain.encode(text, add_special_tokens=False).ids, 2] for text in texts]
    table = pa.array(["before", *texts])
    for step in (1, 7, 300):
        got = [ids.tolist() for at in range(1, len(table), step) for ids in ids_of(table.slice(at, step))]
        assert got == want
    assert ids_of(table.slice(0, 0)) == []
    # a waiting example must not hold its slice's ids
    assert all(ids.base is None and ids.dtype == np.dtype("<u4") for ids in ids_of(table))


def test_memory_moves_keys_met_again():
    memory = Memory(limit=1000)
    memory.put(list("abcdefgh"), "ABCDEFGH")
    assert memory.missing({"a", "b", "x"}) == {"x"}
    assert set(memory.young) == {"a", "b"} and set(memory.old) == set("abcdefgh")
    memory.put(["x"], ["X"])
    assert memory.missing({"a", "c", "x", "y"}) == {"y"}
    assert memory.young == {"a": "A", "b": "B", "c": "C", "x": "X"}


def test_slices_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10] * 7})
    parts = common.slices([batch, batch.slice(0, 0)], 3, 25)
    assert [p.num_rows for p in parts] == [2, 2, 2, 1] and given == [1]
    stopped = common.slices([batch], 3)
    next(stopped)
    stopped.close()
    assert given == [1, 1]
